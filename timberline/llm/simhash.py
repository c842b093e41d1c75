"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link when at most `radius` bits differ, and links reach on.  Each bit
position has a nonzero label of radius + 1 bits; mask v keeps the positions whose label has an
odd product with v.  Any `radius` labels leave some v orthogonal to all of them, so two
fingerprints within the radius agree under that mask: 2**(radius + 1) - 1 tables find every
pair, none by luck.

A bucket with more than HOT different fingerprints is split by a second covering over the
positions that its mask leaves out.  Those parts differ in at most 14 positions for the radius
3, so no task ever compares more than 16,384 values with each other.  A bucket sends on only
the stars of its own components, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import column, free_name, prepare, shared_folder, stored, texts

SEED = 42
BITS = 64
#: Different fingerprints of a bucket from which it is split by the second covering.
HOT = 2048


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of the shingles, repeats included; A-Z as a-z, words between ASCII white space."""
    words = text.lower().split()  # of bytes: both treat ASCII only
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(size)))]


def fingerprints_of(items: list[bytes], size: int) -> np.ndarray:
    """One fingerprint a text; a bit is set if over half of the shingles have it, no word gives 0."""
    out = np.zeros(len(items), np.uint64)
    held: list[int] = []
    owners: list[int] = []
    starts: list[int] = []

    def settle() -> None:
        if not owners:
            return
        bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.diff(np.append(starts, len(held)))
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[owners] = np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()
        held.clear(), owners.clear(), starts.clear()

    for i, text in enumerate(items):
        if hashes := shingle_hashes(text, size):
            owners.append(i)
            starts.append(len(held))
            held.extend(hashes)
            if len(held) > 100_000:
                settle()
    settle()
    return out


def with_fingerprint(docs: DataFrame, name: str = "fp", size: int = 3) -> DataFrame:
    """All columns of `docs` and the fingerprint of its text as a long."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(fingerprints_of(texts(batch), size).view(np.int64))
            yield pa.record_batch([*batch.columns, found], [*batch.schema.names, name])

    return docs.mapInArrow(add, schema)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """2**(radius + 1) - 1 masks over these positions; any `radius` positions are all left out by one of them."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << p for i, p in enumerate(positions) if ((1 + i % top) & v).bit_count() % 2) for v in range(1, top + 1)]


def _long(value: int) -> Column:
    return F.lit(value - (1 << BITS) if value >> (BITS - 1) else value).cast("long")


def _stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links from each value to the smallest one of its component; the values are different and sorted."""
    root = np.arange(len(values))
    bits = values.view(np.uint64)
    for i in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= radius) + i + 1
        if len(near):
            joined = np.unique(root[np.append(near, i)])
            if len(joined) > 1:
                root[np.isin(root, joined[1:])] = joined[0]
    member = np.flatnonzero(root != np.arange(len(values)))
    return list(zip(values[member].tolist(), values[root[member]].tolist()))


def links(fps: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of different fingerprints whose components are those of all pairs within the radius.

    `fps` has the different fingerprints, in column fp.
    """
    masks = covering_masks(list(range(BITS)), radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_long(m)).alias("k")) for t, m in enumerate(masks)))
    keys = fps.select("fp", F.inline(tables))
    full = keys.groupBy("t", "k").agg(F.count("*").alias("n"))
    many = full.where(F.col("n") > hot).select("t", "k", F.lit(True).alias("split"))
    inner = [covering_masks([p for p in range(BITS) if not m >> p & 1], radius) for m in masks]
    second = F.array(*(F.array(*(_long(x) for x in row)) for row in inner))
    several = F.transform(
        F.element_at(second, F.col("t") + 1),
        lambda x, i: F.struct((i + 1).cast("int").alias("s"), F.col("fp").bitwiseAND(x).alias("j")),
    )
    one = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("j")))
    some = full.where((F.col("n") > 1) & (F.col("n") <= hot)).select("t", "k", F.lit(False).alias("split"))
    keys = keys.join(many.unionByName(some), ["t", "k"])
    keys = keys.select("fp", "t", "k", F.inline(F.when(F.col("split"), several).otherwise(one)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last bucket, which may go on in the next batch

        def found(rows: np.ndarray, edges: np.ndarray) -> pa.RecordBatch | None:
            pairs = [x for a, b in zip(edges[:-1], edges[1:]) if b - a > 1 for x in _stars(rows[a:b, 4], radius)]
            if pairs:
                a, b = zip(*pairs)
                return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            return None

        for batch in batches:
            rows = np.stack([column(batch, c).to_numpy().astype(np.int64) for c in ("t", "k", "s", "j", "fp")], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            if len(change):
                if (out := found(rows, np.concatenate([[0], change]))) is not None:
                    yield out
                rows = rows[change[-1] :]
            held = rows
        if held is not None and (out := found(held, np.array([0, len(held)]))) is not None:
            yield out

    by = ["t", "k", "s", "j"]
    return keys.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the links (a, b) reaches.

    Large-star and small-star steps in turn (Kiveris and others, 2014), which need about
    log(n) rounds for a chain of n; each round is checkpointed in the shared folder.
    """
    shared_folder(edges.sparkSession)

    def step(links: DataFrame, large: bool) -> DataFrame:
        # each node's smallest neighbour or itself, given to the larger (large) or smaller neighbours
        if large:
            both = links.union(links.select("b", "a"))
        else:
            both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        given = both.join(least, "a")
        if large:
            return given.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        rest = given.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()

    def state(links: DataFrame) -> tuple:
        r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).checkpoint()
    before = state(now)
    while before[0]:
        now = step(step(now, True), False).checkpoint()
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())


def classes(rows: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """For rows (doc_id, fp): fp, root (the smallest fp of its component), component_id (its smallest doc_id)."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    found = components(links(distinct.select("fp"), radius, hot))
    reached = found.join(distinct, found.node == distinct.fp).groupBy("root").agg(F.min("least").alias("lowest"))
    named = found.join(reached, "root").select(F.col("node").alias("fp"), "root", "lowest")
    return distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    A text of fewer words than a shingle is one shingle; NULL, empty and blank texts have the
    fingerprint zero and link like any other.  component_id is the smallest doc_id that is not
    NULL in the component, NULL if there is none.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = with_fingerprint(rows, size=size).select("doc_id", "fp").checkpoint()
    named = classes(rows, radius).select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each component.

    It is the one with the smallest doc_id, NULL last; of rows that agree in that, any one.
    """
    prepare(docs.sparkSession)
    mark, row = (free_name(docs, x) for x in ("fp", "row"))
    rows = stored(with_fingerprint(docs, mark, size).withColumn(row, F.monotonically_increasing_id()), "simhash")
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("fp"), F.col(row).alias("row"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    stay = ids.join(classes(ids, radius).select("fp", "root"), "fp").groupBy("root").agg(best.alias("x"))
    return rows.join(stay.select(F.col("x.row").alias(row)), row, "left_semi").select(*docs.columns)
