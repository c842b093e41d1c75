"""The near-duplicate stage takes candidates from fingerprints too, and workers remember for one operator at a time."""

from __future__ import annotations

import random

from timberline.llm import common, similar


def test_fingerprints_make_candidates(spark):
    """Without any band key, texts of one or of near fingerprints are found, and the check still decides."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    base, other = (rng.choices(words, k=200) for _ in range(2))
    near = [*base[:-1], "x"]
    texts = {1: base, 2: near, 3: other, 4: [*other[:-1], "y"], 5: rng.choices(words, k=200)}
    nodes = [(i, 196, [], fp) for i, fp in ((1, 0), (2, 0b111), (3, 1 << 40), (4, 1 << 40), (5, 0b1))]
    nodes = spark.createDataFrame(nodes, "node long, n long, keys array<long>, fp long")
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "node long, text string")
    common.prepare(spark)
    common.shared_folder(spark)
    found = {(r["node"], r["root"]) for r in similar.groups(nodes, rows).collect()}
    assert found == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_one_memo_at_a_time():
    one, two = common.memo(), common.memo()
    one["x"], two["y"] = 1, 2
    common.forget_others(two)
    assert one == {} and two == {"y": 2}
    common.forget_others()
    assert two == {}
