"""The pipeline on odd rows and on given tables."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.conftest import ROWS
from tests.llm.test_similar import firsts
from timberline.llm import common, decontamination

FOLDER = "/root/testdata/sf0.01"


def test_stages_keep_columns(spark, odd):
    docs = common.stored(odd, "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        docs = common.stored(after, name)
    rows = corpus_pipeline.tokens(spark, docs, FOLDER)
    assert rows.count() == docs.count() <= len(ROWS)


def test_stages_of_an_empty_table(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_decisions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    whole = docs.count()
    spoken = common.stored(corpus_pipeline.language(spark, docs, FOLDER), "a")
    assert 0.99 * whole <= spoken.count() <= whole
    single = common.stored(corpus_pipeline.near_duplicates(spark, spoken, FOLDER), "b")
    assert {r[0] for r in single.select("doc_id").collect()} == firsts([tuple(r) for r in spoken.select("doc_id", "text").collect()])
    clean = common.stored(corpus_pipeline.decontamination(spark, single, FOLDER), "c")
    found = decontamination.contamination(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert sorted(r[0] for r in clean.select("doc_id").collect()) == sorted(r[0] for r in found.where("not contaminated").select("doc_id").collect())
    mixed = common.stored(corpus_pipeline.mixing(spark, clean, FOLDER), "d")
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    rows = corpus_pipeline.tokens(spark, mixed, FOLDER)
    assert sorted(r[0] for r in rows.select("doc_id").collect()) == sorted(r[0] for r in mixed.select("doc_id").collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
