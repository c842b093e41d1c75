"""How queries and blocks of the vector search meet."""

from __future__ import annotations

import numpy as np
import pytest

from timberline.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(0, 0.3, 6 if i % 7 else 3).tolist()) for i in range(900)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def best(rows, every=50, k=5):
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    out = []
    for q, v in whole:
        if q % every == 0:
            others = sorted((-int(v @ w), i) for i, w in whole if i != q and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(others, 1)]
    return sorted(out)


def test_nothing_is_broadcast(spark, vectors):
    """Queries that are few bytes go to many cells: as the small side of a join they would pass the driver that many times."""
    rows, df = vectors
    kept = {key: spark.conf.get(key) for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = topk.top_neighbours(df)
        got = sorted(map(tuple, found.collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert "Broadcast" not in plan.split("== Initial Plan ==")[0]
    assert got == best(rows)


def test_cells_give_the_same_however_many(spark, vectors, monkeypatch, tmp_path):
    """Blocks and packs of any number, in cells that hold one block alone or many."""
    rows, df = vectors
    index = spark.read.schema(topk.INDEX).parquet(topk.build_index(df, f"{tmp_path}/index", block=32))
    queries = df.where("vec_id % 10 = 0")
    for held, packs in ((1, 1), (1 << 26, 8)):
        monkeypatch.setattr(topk, "HELD", held)
        monkeypatch.setattr(topk, "PACKS", packs)
        got = sorted(map(tuple, topk.search(queries, index, 5, per_block=4).collect()))
        assert got == best(rows, 10)


def test_grid_is_bounded():
    """Cells hold few bytes, and copies grow with the root of the tasks, not with the tasks or the queries."""
    deals, groups = topk.grid(n_blocks=50, largest=1_500_000, n_packs=48, tasks=600)
    assert deals <= 50 and groups <= 6
    deals, groups = topk.grid(n_blocks=2000, largest=30_000_000, n_packs=2500, tasks=400)
    assert deals == 2000 and groups == 1
    assert topk.grid(0, 0, 1, 12) == (1, 1)


def test_numbers_of_blocks_run_on(spark, vectors, tmp_path):
    index = spark.read.schema(topk.INDEX).parquet(topk.build_index(vectors[1], f"{tmp_path}/index", block=32))
    blocks, n, largest = topk.numbered(index)
    assert sorted(r["number"] for r in blocks.collect()) == list(range(n)) and n == index.count() and largest > 0
