"""Exact top-k search by inner product on a bit-sliced index.

The index keeps blocks of vectors as bitmaps: slice (d, b) has bit b of attribute d of all
vectors of the block, less the smallest value of that attribute there.  A query adds slices with
bitmap full adders: attribute d comes in once for each set bit of the query's weight, moved to
that bit; for a negative weight the complement of the slices comes in.  The sum is again a
number in slices, never a number per row.  The top rows are then chosen from its most
significant slice downward, and the rows that tie at the boundary by their ids.

Blocks are dealt to cells, and queries, in packs, go to all cells of their group.  A cell holds a
bounded number of bytes of blocks while the packs pass by; each pack and block give k rows a
query, from which the final ranks are taken.  Nothing is broadcast: packs are small, but they go to many
cells, which Spark does not see when it takes a small side for one that may be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import binaries, column, new_path, partitions, prepare

#: Vectors in a block of the index, and queries in a block.
BLOCK = 1 << 14
QUERIES = 256
#: Bytes of blocks that a cell holds, or one block, and packs that a copy of a block is made for at least.
HELD = 1 << 26
PACKS = 8
#: Quantised components and scores lie from -LIMIT to LIMIT - 1; anything beyond is an error, never another value.
LIMIT = 1 << 63
INDEX = "dim int, n int, bits int, ids binary, lows binary, slices binary"
PACK = "dim int, pack long, queries binary, weights binary, width int"
HITS = "query long, query_id long, copies long, vec_id long, score long, own boolean"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and its vector as doubles, without vectors that are NULL or hold NULL or non-finite components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in 64 bits."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if len(out) and not (out.min() >= -LIMIT and out.max() < LIMIT):
        raise OverflowError(f"op9_topk: {scale} times a component of a vector does not fit 64 bits")
    return out.astype(np.int64)


def quantised(rows: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids, and floor(scale * x) of each vector."""
    v = column(rows, "v")
    flat = whole(v.flatten().to_numpy(), scale)
    sizes = np.diff(v.offsets.to_numpy())
    return column(rows, "vec_id").to_numpy(), np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """Booleans along the last axis as words of 64 bits; the length is a multiple of 64."""
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


def build_block(ids: np.ndarray, values: np.ndarray) -> dict:
    """Slices of one block; rows are put in order of their ids."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    lows = values.min(axis=0) if values.shape[1] else np.zeros(0, np.int64)
    up = np.zeros((values.shape[1], -(-len(ids) // 64) * 64), np.uint64)
    up[:, : len(ids)] = (values.view(np.uint64) - lows.view(np.uint64)).T  # right without a sign, however far apart
    bits = int(up.max(initial=0)).bit_length()
    slices = np.stack([pack_bits((up >> np.uint64(b) & np.uint64(1)).astype(np.uint8)) for b in range(bits)], axis=1) if bits else np.zeros(0, np.uint64)
    return {
        "dim": values.shape[1], "n": len(ids), "bits": bits,
        "ids": ids.astype("<i8").tobytes(), "lows": lows.astype("<i8").tobytes(), "slices": slices.tobytes(),
    }


class Block:
    """One block of the index."""

    def __init__(self, row: dict) -> None:
        self.n, dim, self.bits = row["n"], row["dim"], row["bits"]
        self.ids, self.lows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lows"], "<i8")
        words = -(-self.n // 64)
        slices = np.frombuffer(row["slices"], np.uint64).reshape(dim, self.bits, words)
        self.both = np.stack([slices, ~slices])  # for weights above and below zero
        self.all = pack_bits((np.arange(words * 64) < self.n).astype(np.uint8))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of sum(|q| * (x - low or its complement)), least significant first, and what to add to it."""
        weight = np.abs(query).view(np.uint64)
        negative = (query < 0).astype(np.int64)
        with_bit = [np.flatnonzero(weight >> np.uint64(j) & np.uint64(1)) for j in range(int(weight.max(initial=0)).bit_length())]
        out, carried, place = [], None, 0
        while place < min(1, self.bits) * (len(with_bit) + self.bits - 1) or carried is not None:
            parts = [self.both[negative[dims], dims, place - j] for j, dims in enumerate(with_bit) if 0 <= place - j < self.bits and len(dims)]
            parts += [carried] if carried is not None else []
            stack = np.concatenate(parts) if parts else np.zeros((0, len(self.all)), np.uint64)
            carries = []
            while len(stack) > 1:  # full adders take three bitmaps of one weight to one, and one of the next weight
                k = len(stack) // 3
                if k:
                    a, b, c = stack[:k], stack[k : 2 * k], stack[2 * k : 3 * k]
                    x = a ^ b
                    carries.append((a & b) | (c & x))
                    stack = np.concatenate([x ^ c, stack[3 * k :]])
                else:
                    carries.append(stack[:1] & stack[1:])
                    stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros(len(self.all), np.uint64))
            carried = np.concatenate(carries) if carries else None
            place += 1
        full = (1 << self.bits) - 1
        offset = sum(int(q) * int(low) if q >= 0 else int(q) * (int(low) + full) for q, low in zip(query.tolist(), self.lows.tolist()))
        return out, offset

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to smaller ids, and which may be the query's own row, of the id `own`.

        A score of the query with itself that is beyond 64 bits is the largest number.
        """
        sums, offset = self.scores(query)
        live = self.all.copy()
        sure, tied = np.zeros_like(live), live
        for bitmap in reversed(sums):
            with_bit = tied & bitmap
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(with_bit).sum())
            if n > k:
                tied = with_bit
            else:
                sure, tied = sure | with_bit, tied & ~bitmap
        chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        edge = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: max(0, k - len(chosen))]
        rows = np.concatenate([chosen, edge])
        narrow = len(sums) < 63 and abs(offset) < LIMIT // 2
        score = np.full(len(rows), offset, np.int64 if narrow else object)
        for place, bitmap in enumerate(sums):
            score += (bitmap[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(score.dtype) << place
        itself = sum(x * x for x in query.tolist())
        mine = (self.ids[rows] == own) & np.array([x == itself for x in score.tolist()], bool)
        if not narrow:  # Python integers
            score[mine] = min(itself, LIMIT - 1)
            if any(not -LIMIT <= x < LIMIT for x in score):
                raise OverflowError("op9_topk: an inner product does not fit 64 bits")
            score = score.astype(np.int64)
        return self.ids[rows], score, mine


def build_index(vectors: DataFrame, path: str, scale: int = 256, block: int = BLOCK) -> str:
    """Write the bit-sliced index of all usable vectors; vectors of different lengths go to different blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, values = held.pop(dim)
            row = build_block(np.array(ids, np.int64), np.stack(values))
            small = [pa.array([row[c]], pa.int32()) for c in ("dim", "n", "bits")]
            return pa.record_batch([*small, *(binaries([row[c]]) for c in ("ids", "lows", "slices"))], ["dim", "n", "bits", "ids", "lows", "slices"])

        for batch in batches:
            for vec_id, vector in zip(*quantised(batch, scale)):
                ids, values = held.setdefault(len(vector), ([], []))
                ids.append(vec_id)
                values.append(vector)
                if len(ids) == block:
                    yield flush(len(vector))
        for dim in list(held):
            yield flush(dim)

    usable(vectors).mapInArrow(build, INDEX).write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)
    return path


def numbered(index: DataFrame) -> tuple[DataFrame, int, int]:
    """The blocks with a `number` from 0 on, how many there are, and the bytes of slices of the largest.

    The numbers only balance the work: the driver gets one row a read task.
    """
    at = index.withColumn("part", F.spark_partition_id())
    rows = at.groupBy("part").agg(F.count("*").alias("n"), F.max(F.octet_length("slices")).alias("size")).collect()
    counts = {row["part"]: row["n"] for row in rows}
    before = np.cumsum([0, *(counts.get(p, 0) for p in range(max(counts, default=0)))]).tolist()
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    number = place + F.coalesce(F.get(F.lit(before), F.spark_partition_id()), F.lit(0))
    return index.withColumn("number", number), sum(counts.values()), max((row["size"] for row in rows), default=0)


def grid(n_blocks: int, largest: int, n_packs: int, tasks: int) -> tuple[int, int]:
    """To how many deals the blocks go, and to how many groups the packs: each block is copied to all groups, each pack to all deals.

    A block takes the bytes of about ten times the queries, and their hits, of as many vectors, so copies of both
    weigh the same with the root of ten deals a task; more deals are made where blocks are too large to be held.
    """
    room = max(1, HELD // max(1, 2 * largest))
    deals = max(1, -(-n_blocks // room), min(n_blocks, math.isqrt(10 * tasks)))
    return deals, max(1, min(-(-n_packs // PACKS), -(-tasks // deals)))


def packed(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Packs of queries as bytes: the numbers of each query, and its weights as the smallest integers that hold all of a pack."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            keys = np.array([[q[c] for c in ("query", "vec_id", "copies")] for q in row["queries"]], "<i8")
            weights = whole(np.array([q["v"] for q in row["queries"]], np.float64).ravel(), scale)
            width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(weights) or (weights.min() >= -(1 << 8 * w - 1) and weights.max() < 1 << 8 * w - 1))
            cells = [pa.array([row["dim"]], pa.int32()), pa.array([row["pack"]], pa.int64()), binaries([keys.tobytes()]), binaries([weights.astype(f"<i{width}").tobytes()]), pa.array([width], pa.int32())]
            yield pa.record_batch(cells, ["dim", "pack", "queries", "weights", "width"])


def search(queries: DataFrame, index: DataFrame, k: int, scale: int = 256, per_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of the index for each query vector.

    The queries (vec_id, embedding) are rows of the index, and each finds all rows but itself: it looks for
    one row more than k, from which one of its own id and its own score goes, if there is one; rows
    alike in both give the same answer.  Equal query rows are searched once and answered each.
    Vectors of another length than the query's are not candidates.
    """
    spark = index.sparkSession
    wanted = usable(queries).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    wanted = wanted.withColumn("query", F.monotonically_increasing_id()).checkpoint()
    n = max(1, -(-wanted.count() // per_block))
    packs = wanted.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("query"), F.lit(n)).alias("pack"))
    packs = packs.agg(F.collect_list(F.struct("query", "vec_id", "copies", "v")).alias("queries"))
    blocks, n_blocks, largest = numbered(index)
    deals, groups = grid(n_blocks, largest, n, partitions(spark))
    blocks = blocks.select(F.pmod("number", F.lit(deals)).alias("deal"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), *index.columns)
    packs = packs.mapInArrow(lambda batches: packed(batches, scale), PACK)
    packs = packs.select(F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.pmod("pack", F.lit(groups)).alias("group"), "*")
    cells = blocks.unionByName(packs, allowMissingColumns=True).withColumn("cell", (F.col("deal") * groups + F.col("group")).cast("int")).drop("deal", "group")
    cells = cells.repartitionById(deals * groups, F.col("cell")).sortWithinPartitions("cell", F.col("pack").asc_nulls_first())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Block]] = {}
        cell = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["cell"] != cell:
                    held, cell = {}, row["cell"]
                if row["pack"] is None:
                    held.setdefault(row["dim"], []).append(Block(row))
                    continue
                keys = np.frombuffer(row["queries"], "<i8").reshape(-1, 3)
                weights = np.frombuffer(row["weights"], f"<i{row['width']}").reshape(len(keys), row["dim"])
                for block in held.get(row["dim"], []):
                    found = []
                    for key, vector in zip(keys, weights):
                        ids, score, own = block.top(vector.astype(np.int64), k + 1, int(key[1]))
                        found.append((*(np.full(len(ids), x, np.int64) for x in key), ids, score, own))
                    parts = [pa.array(np.concatenate(x)) for x in zip(*found)]
                    yield pa.record_batch(parts, ["query", "query_id", "copies", "vec_id", "score", "own"])

    hits = cells.mapInArrow(look, HITS)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", F.col("own").desc())
    near = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    itself = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("query"))
    near = near.withColumn("itself", F.coalesce(itself, F.lit(k + 2))).where(F.col("place") != F.col("itself"))
    near = near.withColumn("rank", F.col("place") - (F.col("place") > F.col("itself")).cast("int")).where(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    beyond = F.raise_error(F.lit("op9_topk: an inner product does not fit 64 bits"))
    score = F.when(F.col("own") & (F.col("score") == LIMIT - 1), beyond.cast("long")).otherwise(F.col("score"))
    return near.select("query_id", "rank", "vec_id", score.alias("score"), again.alias("copy")).drop("copy")


def top_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, path: str | None = None) -> DataFrame:
    """The k best other vectors for each vector whose id is divisible by `every`.

    NULL ids, NULL vectors and vectors with NULL or non-finite components take no part.  Rows of
    one id are queries and candidates each, also for one another.  An empty table gives an
    empty result; fewer than k candidates are all returned.  Components and scores are exact in 64
    bits; where one does not fit, the job fails with an OverflowError.
    """
    spark = prepare(vectors.sparkSession)
    path = build_index(vectors, path or new_path(spark, "slices"), scale)
    queries = vectors.where(F.col("vec_id") % every == 0)
    return search(queries, spark.read.schema(INDEX).parquet(path), k, scale)
