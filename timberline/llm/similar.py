"""Near duplicates by Jaccard similarity of word shingles: min-hash bands for candidates, whole texts for the check.

A text is the set of its shingles of SIZE words.  BANDS keys of ROWS min-hashes each make two
texts candidates where a key agrees: of pairs of similarity 0.8 one in 16,000 shares no key, of
0.85 one in three million.  A candidate pair links only if the sets themselves agree in 4 of 5.

Before the keys, texts whose 5-word fingerprints (`simhash.py`, covering tables) differ in 3 bits or fewer are candidates
as well; they pass the same check, so they add pairs that share no key and never take one away.

Candidates come in two steps, so that a large group of near copies does not send all its pairs.
First each text goes to the smallest one under its key or fingerprint, and what links is contracted.  Then only
keys that hold several components are looked at again.  A key of a FEW members sends the pairs across
its components.  A key of more, such as a group whose copies are not alike enough to link to the smallest one, is
dealt out in blocks, and blocks are compared whole, by matrix products over the shingles they share.
So every pair that shares a key is either compared or already in one component, and the rows sent
grow with the members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import SPACED, WEIGHTS, binaries, column, forget_others, free_name, mix64, prepare, scan, stored, texts
from timberline.llm.simhash import SEED, components, fingerprints_of, links

SIZE = 5
BANDS, ROWS = 32, 6
#: Shingles that go through all min-hashes in one go.
GO = 1 << 16
#: Members of a key up to which its pairs are sent one by one.
FEW = 32
#: Members of a block: at least, where a key has up to 16 blocks, and at most; and shingles of a block at most (a longer text is alone).
BLOCK, LARGE, SHINGLES = 256, 2048, 1 << 20
#: Shingles of one matrix product.
COLUMNS = 2048

_FACTORS = mix64((np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(items: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of all texts in a row, and their number for each text.

    A-Z as a-z, words between ASCII white space; a text of fewer words than a shingle is one shingle.
    """
    words, counts = scan(items, SPACED)
    first = np.cumsum(counts) - counts
    hashes, owners = [], []
    for n in range(1, size + 1):
        docs = np.flatnonzero(counts >= n if n == size else counts == n)
        many = counts[docs] - n + 1
        owner = np.repeat(docs, many)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + first[owner]
        total = np.full(len(owner), n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                total += words[begin + i] * WEIGHTS[i]
        hashes.append(mix64(total))
        owners.append(owner)
    flat, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[new], np.bincount(owner[new], minlength=len(items))


def band_keys(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS keys of each text; every text has a shingle."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        start = ends[a] - counts[a]
        b = max(a + 1, int(np.searchsorted(ends, start + GO, "right")))
        part, starts = flat[start : ends[b - 1]], ends[a:b] - counts[a:b] - start
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                key = np.full(b - a, band, np.uint64)
                for i in range(ROWS):
                    key = mix64(key + np.minimum.reduceat(mix_low(part * _FACTORS[band * ROWS + i]), starts))
                out[a:b, band] = key
        a = b
    return out


def mix_low(x: np.ndarray) -> np.ndarray:
    """The well-mixed upper half of a product, folded in so that the order under different factors is independent."""
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def with_keys(docs: DataFrame, node: str, size: str, keys: str, fp: str) -> DataFrame:
    """All columns of `docs`, and of its text a hash of the shingle set, the size of the set, its band keys and its fingerprint."""
    added = [T.StructField(node, T.LongType()), T.StructField(size, T.LongType()), T.StructField(keys, T.ArrayType(T.LongType()))]
    added.append(T.StructField(fp, T.LongType()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            items = texts(batch)
            flat, counts = shingle_sets(items)
            ends = np.cumsum(counts).tolist()
            digests = [xxhash.xxh64_intdigest(flat[e - c : e].tobytes(), SEED) for e, c in zip(ends, counts.tolist())]
            some = counts > 0
            offsets = np.concatenate([[0], np.cumsum(some * BANDS)])
            values = band_keys(flat, counts[some]).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            columns = [pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(counts.astype(np.int64)), lists]
            columns.append(pa.array(fingerprints_of(items, SIZE).view(np.int64)))
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, node, size, keys, fp])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, *added]))


def _may(a: Column, b: Column) -> Column:
    """Sets of these sizes can have the similarity 0.8."""
    return 4 * F.greatest(a, b) <= 5 * F.least(a, b)


def _checked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts agree in 4 of 5 shingles; `rows` has a text for each node."""
    pairs = pairs.checkpoint()
    wanted = pairs.select("a").union(pairs.select("b")).distinct()
    some = stored(rows.join(wanted.withColumnRenamed("a", "node"), "node", "left_semi"), "candidates")
    both = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(some.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            sides = []
            for name in ("x", "y"):
                flat, counts = shingle_sets(texts(batch, name))
                sides.append((np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else [], counts))
            (xs, n), (ys, m) = sides
            same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(xs, ys)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(9 * same >= 4 * (n + m)))

    return both.mapInArrow(compare, "a long, b long").checkpoint()


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles: the sorted shingle hashes of the texts of these nodes, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            flat, counts = shingle_sets(texts(batch))
            pieces = np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []
            yield pa.record_batch([column(batch, "node"), binaries(x.tobytes() for x in pieces)], ["node", "shingles"])

    return stored(rows.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(run, "node long, shingles binary"), "sets")


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Shingles that each of xs shares with each of ys: a product of 0-1 matrices over the shingles that occur twice."""
    both = [*xs, *ys]
    sizes = [len(x) for x in both]
    _, place, times = np.unique(np.concatenate([*both, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[place] > 1
    owner, place = np.repeat(np.arange(len(both)), sizes)[keep], shared[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(xs), len(ys)), np.int64)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [start, start + COLUMNS])
        part = np.zeros((len(both), COLUMNS), np.float32)
        part[owner[a:b], place[a:b] - start] = 1
        out += (part[: len(xs)] @ part[len(xs) :].T).astype(np.int64)
    return out


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that connect what the others before them do not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """Links between components in one block of a key, or between two: each component pair at most once, as a forest."""
    own, c = (table.column(x).to_numpy() for x in ("own", "c"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    low, high = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    x, y = np.flatnonzero(own == low), np.flatnonzero(own == high)
    same = overlaps([sets[i] for i in x], [sets[i] for i in y])
    linked = (9 * same >= 4 * (n[x][:, None] + n[y][None])) & (c[x][:, None] != c[y][None])
    i, j = np.nonzero(linked)
    pairs = np.unique(np.stack([c[x[i]], c[y[j]]], axis=1), axis=0)
    edges = _forest(pairs)
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _hot_links(inside: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) of components in keys of many members; inside (k, node, c, members, total).

    A key's members are dealt to blocks, and each pair of blocks is one group of bounded size.  No pair of texts
    is a row; what leaves a group is a forest over its components.
    """
    blocks = F.greatest(F.ceil(F.col("members") / LARGE), F.ceil(F.col("total") / SHINGLES), F.least(F.lit(16), F.ceil(F.col("members") / BLOCK))).cast("int")
    dealt = inside.select("k", "node", "c", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("node", "k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "c")
    some = _sets(rows, inside.select("node").distinct())
    return dealt.join(some, "node").groupBy("k", "lo", "hi").applyInArrow(_block_links, "a long, b long").checkpoint()


def _prints(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) of fingerprints within 3 bits: a node and the smallest one of its fingerprint or of a linked one."""
    first = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("lead")).checkpoint()
    same = nodes.join(first, "fp").select(F.struct("node", "n").alias("x"), F.col("lead").alias("y"))
    found = links(first.select("fp"))
    x, y = (first.select(F.col("fp").alias(c), F.col("lead").alias(d)) for c, d in (("a", "x"), ("b", "y")))
    pairs = same.union(found.join(x, "a").join(y, "b").select("x", "y")).where((F.col("x.node") != F.col("y.node")) & _may(F.col("x.n"), F.col("y.n")))
    return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))


def groups(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, root of the nodes that link to another; nodes (node, n, keys, fp), rows (node, text)."""
    buckets = nodes.select("node", "n", F.explode("keys").alias("k"))
    lead = buckets.groupBy("k").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("members")).where("members > 1")
    shared = buckets.join(lead.select("k", "lead"), "k").checkpoint()
    stars = shared.where((F.col("node") != F.col("lead.node")) & _may(F.col("n"), F.col("lead.n")))
    stars = stars.select(F.col("node").alias("a"), F.col("lead.node").alias("b"))
    stars = stars.union(_prints(nodes)).distinct().checkpoint()
    found = _checked(stars, rows)
    named = components(found)
    inside = shared.join(named, "node", "left").select("k", "node", "n", F.coalesce("root", "node").alias("c"))
    several = inside.groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("members"), F.sum("n").alias("total"))
    inside = inside.join(several.where("least <> most").select("k", "members", "total"), "k").checkpoint()
    few = inside.where(F.col("members") <= FEW)
    x, y = (few.select("k", *(F.col(c).alias(c + s) for c in ("node", "n", "c"))) for s in "xy")
    across = x.join(y, "k").where((F.col("cx") != F.col("cy")) & (F.col("nodex") > F.col("nodey")) & _may(F.col("nx"), F.col("ny")))
    across = across.select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    many = _hot_links(inside.where(F.col("members") > FEW), rows)
    return components(found.union(_checked(across, rows)).union(many))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group of texts that 0.8 similar pairs link.

    It is the one with the smallest doc_id, NULL last; of rows that agree in that, any one.
    NULL, empty and blank texts have the empty set and are one group.
    """
    prepare(docs.sparkSession)
    node, size, keys, fp, row = (free_name(docs, x) for x in ("node", "n", "keys", "fp", "row"))
    rows = stored(with_keys(docs, node, size, keys, fp).withColumn(row, F.monotonically_increasing_id()), "similar")
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(node).alias("node"), F.col(row).alias("row"))
    values = (F.any_value(size).alias("n"), F.any_value(keys).alias("keys"), F.any_value(fp).alias("fp"))
    nodes = rows.groupBy(F.col(node).alias("node")).agg(F.min(row).alias("row"), *values).checkpoint()
    one = rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")).join(nodes.select("node", "row"), "row").select("node", "text")
    named = groups(nodes.select("node", "n", "keys", "fp"), one)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    stay = ids.join(named, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(best.alias("x"))
    return rows.join(stay.select(F.col("x.row").alias(row)), row, "left_semi").select(*docs.columns)
