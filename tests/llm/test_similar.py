"""The near-duplicate stage against all pairs of 5-word sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import plain_words
from timberline.llm import similar


def shingles(text: str | None) -> frozenset[tuple[str, ...]]:
    words = plain_words(text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def firsts(rows: list[tuple[int, str | None]]) -> set[int]:
    """The smallest id of each group that pairs of similarity 0.8 link."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i, _ in sets}


def test_edited_copies_are_linked(spark):
    """Copies with replaced, cut and added words from similarity 0.6 to 1, a chain of small edits, short and empty texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts: list[str | None] = []
    for edits in range(8):
        for n in (60, 150, 400):
            text = rng.choices(words, k=n)
            texts.append(" ".join(text))
            copy = list(text)
            for _ in range(edits * n // 150 + 1):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([1, 1, 0])] = rng.choice([[], ["new"], ["NEW", "one"]])
            texts.append("\t".join(copy).upper())
    link = rng.choices(words, k=100)
    for _ in range(40):  # neighbours in the chain are alike, its ends are not
        texts.append(" ".join(link))
        link = link[2:] + rng.choices(words, k=2)
    texts += [None, "", " \n", "a b", "A  b", "b a", "a b c d e", "a b c d e f"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == firsts(rows)
    assert similar.one_of_each(docs.limit(0)).count() == 0


def template_copies(rng: random.Random, members: int, words: int = 100) -> list[str]:
    """Copies of one text with 1 to 6 words replaced: of each other they are 0.4 to 0.98 alike, many just above or below 0.8."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for _ in range(members):
        text = list(base)
        for at in rng.sample(range(words), rng.choice([1, 2, 2, 3, 3, 4, 6])):
            text[at] = f"n{rng.randrange(100)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("few", "block", "large"), [(32, 256, 2048), (4, 8, 16)])
def test_hot_keys_lose_no_link(spark, monkeypatch, few, block, large):
    """A large group whose members mostly do not link to one of them, in blocks of two sizes."""
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "LARGE", large)
    rng = random.Random(few)
    texts = template_copies(rng, 220) + [" ".join(rng.choices([f"v{i}" for i in range(500)], k=60)) for _ in range(30)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == firsts(rows)


def test_overlaps_are_those_of_the_sets(monkeypatch):
    monkeypatch.setattr(similar, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    xs, ys = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.integers(0, 40, 25)] for _ in range(2))
    got = similar.overlaps(xs, ys)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert similar.overlaps([], []).shape == (0, 0)


def test_near_duplicates_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {r["doc_id"] for r in similar.one_of_each(docs).collect()} == firsts(rows)
