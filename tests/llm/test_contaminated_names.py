"""The pipeline's decontamination names documents by their text and stores no copy of the texts."""

from __future__ import annotations

import corpus_pipeline

PASSAGE = " ".join(f"item{i}" for i in range(13))


def test_rows_that_stay(spark, tmp_path):
    spark.createDataFrame([("a", PASSAGE)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [
        (1, f"before {PASSAGE} after", "x"), (1, "clean", "x"), (1, "clean", "y"), (None, PASSAGE.upper(), "x"), (None, None, "x"),
        (2, "", None), (3, f"{PASSAGE} " + "word " * 400, "x"), (4, f"before {PASSAGE} after", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    stay = [rows[i] for i in (1, 2, 4, 5, 6)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(stay, key=str)


def test_no_copy_of_the_texts(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("a", PASSAGE)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, real = [], corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, label: kept.append(df.columns) or real(df, label))
    docs = spark.createDataFrame([(1, PASSAGE), (2, "clean")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()] == [2]
    assert all("text" not in columns for columns in kept)
