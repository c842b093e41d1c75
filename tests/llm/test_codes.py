"""Vector codes against a plain search of all entries, and odd vectors."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from timberline.llm import codes

NAN, INF = float("nan"), float("inf")


def plain(rows: list[tuple], parts: int, entries: int, rounds: int, scale: int) -> dict[tuple, int]:
    """The report of Python integers, as a multiset."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [[(v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]

    def assign(p: int, x: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members: dict[int, list] = {}
            for x in cut:
                members.setdefault(assign(p, x[p])[1], []).append(x[p])
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [[assign(p, x[p]) for p in range(parts)] for x in cut]
    sums: dict = {}
    for (_, _, label), f in zip(kept, found):
        sums[label] = sums.get(label, 0) + sum(d for d, _ in f)
    out: dict[tuple, int] = {}
    for (i, _, label), f in zip(kept, found):
        row = (i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), sums[label], digest)
        out[row] = out.get(row, 0) + 1
    return out


def counted(df) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for r in df.collect():
        row = tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256"))
        out[row] = out.get(row, 0) + 1
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, q string, code string, of int"


def odd_rows() -> list[tuple]:
    rng = random.Random(1)
    near = [[rng.choice([-0.5, 0.0, 0.25]) for _ in range(16)] for _ in range(5)]
    rows = [(i, [x + rng.choice([0.0, 0.01]) for x in rng.choice(near)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(7, near[0], 1), (7, near[0], 1), (None, near[1], 3), (None, near[1], None), (-4, [1.0, 2.0, 3.0], 4), (130, [], 5)]
    rows += [(131, None, 1), (132, [None] + near[0][1:], 1), (133, [NAN] * 16, 1), (134, [INF] + near[0][1:], 2), (135, [-INF] * 3, 2)]
    return rows


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(8, 16, 6), (4, 70, 2), (3, 1, 1), (1, 200, 3)])
def test_against_plain_search(spark, parts, entries, rounds):
    """Ties, repeated rows and ids, odd lengths, more entries than a mask word and than rows."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)
    want = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], parts, entries, rounds, 4096)
    assert counted(codes.vector_codes(df, parts, entries, rounds)) == want


def test_empty_tables_and_vectors(spark):
    df = spark.createDataFrame([(1, [], 1, "", "", 1), (2, [], None, "", "", 1), (3, None, 1, "", "", 1)], SCHEMA)
    assert codes.vector_codes(df.limit(0)).collect() == [] and codes.vector_codes(df.where("vec_id = 3")).collect() == []
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in codes.vector_codes(df).collect()) == [(1, "00" * 8, 0), (2, "00" * 8, 0)]


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 1, "", "", 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        codes.vector_codes(df).collect()


def test_candidates_hold_the_nearest_and_only_those_in_reach():
    rng = np.random.default_rng(4)
    slices = codes.Slices(rng.integers(-50, 50, (130, 4)))
    parts = rng.integers(-60, 60, (300, 4))
    radius = rng.integers(0, 40, 300)
    masks = slices.candidates(parts, radius)
    inside = (np.abs(parts[:, None] - slices.entries[None]) <= radius[:, None, None]).all(axis=2)
    got = np.array([[bool(int(masks[i, e // 64]) >> (e % 64) & 1) for e in range(130)] for i in range(300)])
    assert (got == inside).all()
    gaps = ((parts[:, None] - slices.entries[None]) ** 2).sum(axis=2)
    chosen, best = slices.nearest(parts)
    assert (chosen == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()


def test_decode_gives_entries_back(spark):
    vectors = codes.integer_vectors(spark.createDataFrame([(i, [i / 4, -i / 8], 0) for i in range(4)], "vec_id long, embedding array<float>, label int"))
    books = codes.fit(vectors, parts=2, entries=4, rounds=2)
    assert {r["vec_id"]: books.decode(r["code"]) for r in books.encode(vectors).collect()} == {i: [i / 4, -i / 8] for i in range(4)}
