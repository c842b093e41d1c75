"""Benchmark decontamination with a positional inverted index that is sharded by document.

`build_index` stores the postings of every word of every training text: a shard covers about a
million neighbouring words and holds its sorted term hashes, and for each term the places where
it stands.  A search sends the test items, in blocks, to all shards.  In a shard, the lists of
a phrase are intersected after taking off each term's offset, starting from the rarest term, so
a phrase with a word that the shard lacks costs one lookup.  No text is read twice or shuffled.

Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z.  NULL
and empty texts have no words.  Terms are 64-bit hashes; a wrong match would need equal hashes
for all the words of a phrase at once.  Repeated rows are documents of their own, whatever
their doc_id; items of the same id are one item.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import ALNUM, binaries, column, new_path, partitions, prepare, scan, texts

#: Words of a shard; one longer text makes a longer shard.
SHARD_WORDS = 1 << 20
#: Test items that go to a shard together.
ITEMS = 5000
WINDOW = 13
#: Bytes of item texts up to which they are broadcast.
BROADCAST = 8 << 20
INDEX = "shard long, doc_ids array<{ids}>, n_words array<long>, terms binary, ends binary, postings binary"
FOUND = "shard long, slot int, spans array<struct<a:int,b:int>>, items array<string>"


def schema_of(ids: str = "long") -> str:
    """Columns of an index whose documents are named by a type of Spark, long or string."""
    return INDEX.format(ids=ids)


def build_index(docs: DataFrame, path: str, ids: str = "long") -> str:
    """Write the index of whole texts to `path`."""
    docs = docs.select(F.col("doc_id").cast(ids).alias("doc_id"), F.col("text").cast("string").alias("text"))
    names_type = pa.list_(pa.string() if ids == "string" else pa.int64())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        some: list = []
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            stream = np.concatenate(hashes)
            order = np.argsort(stream, kind="stable")
            terms, first = np.unique(stream[order], return_index=True)
            deltas = np.diff(order, prepend=0)
            deltas[first] = order[first]  # places of a term as steps from one to the next
            return pa.record_batch(
                [
                    pa.array([task << 24 | made], pa.int64()), pa.array([some], names_type),
                    pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int64())), binaries([terms.tobytes()]),
                    binaries([np.append(first[1:], len(stream)).astype(np.uint32).tobytes()]),
                    binaries([deltas.astype(np.uint32).tobytes()]),
                ],
                ["shard", "doc_ids", "n_words", "terms", "ends", "postings"],
            )

        for batch in batches:
            found, n = scan(texts(batch), ALNUM)
            names, stops = column(batch, "doc_id").to_pylist(), np.cumsum(n)
            at = 0
            while at < len(n):  # as many documents as the shard has room for, one at least
                room = SHARD_WORDS - sum(map(len, hashes))
                base = int(stops[at] - n[at])
                upto = max(int(np.searchsorted(stops, base + room, "right")), at if some else at + 1)
                if upto > at:
                    some += names[at:upto]
                    hashes.append(found[base : int(stops[upto - 1])])
                    counts.append(n[at:upto])
                if upto < len(n):
                    yield flush()
                    made, some, hashes, counts = made + 1, [], [], []
                at = upto
        if some:
            yield flush()

    (
        docs.mapInArrow(build, schema_of(ids))
        .write.option("compression", "zstd").option("parquet.block.size", str(16 << 20))
        .option("parquet.block.size.row.check.min", "1").option("parquet.block.size.row.check.max", "1").parquet(path)
    )
    return path


class Shard:
    """The postings of one shard."""

    def __init__(self, terms: bytes, ends: bytes, postings: bytes, n_words: list[int]) -> None:
        self.terms = np.frombuffer(terms, np.uint64)
        self.ends = np.frombuffer(ends, np.uint32).astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.deltas = np.frombuffer(postings, np.uint32)
        self.stops = np.cumsum(n_words)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each term in the vocabulary, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def frequency(self, term: np.ndarray) -> np.ndarray:
        return self.ends[term] - self.begins[term]

    def places(self, term: int) -> np.ndarray:
        return np.cumsum(self.deltas[self.begins[term] : self.ends[term]], dtype=np.int64)

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where these terms stand in a row inside one document; all of them are in the vocabulary."""
        order = np.argsort(self.frequency(terms), kind="stable")
        starts = self.places(terms[order[0]]) - order[0]
        for i in order[1:]:
            if not len(starts):
                return starts
            there = self.places(terms[i])
            at = np.minimum(np.searchsorted(there, starts + i), len(there) - 1)
            starts = starts[there[at] == starts + i]
        starts = starts[starts >= 0]
        slot = np.searchsorted(self.stops, starts, "right")
        return starts[starts + len(terms) <= self.stops[slot]]

    def near(self, terms: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the shortest stretches, at most `width` words long, that hold all terms."""
        lists = [self.places(t) for t in dict.fromkeys(terms.tolist())]
        last = np.unique(np.concatenate(lists))
        first = last.copy()
        for places in lists:
            at = np.searchsorted(places, last, "right") - 1
            first = np.where((at < 0) | (first < 0), -1, np.minimum(first, places[at]))
        keep = (first >= 0) & (last - first < width)
        first, last = first[keep], last[keep]
        same = np.searchsorted(self.stops, first, "right") == np.searchsorted(self.stops, last, "right")
        first, last = first[same], last[same]
        shortest = np.append(first[:-1] < first[1:], True) if len(first) else same[:0]
        starts = np.append(True, first[1:] > first[:-1]) if len(first) else shortest
        return first[starts], last[starts]


def item_blocks(items: DataFrame, per_block: int = ITEMS) -> tuple[DataFrame, int, int]:
    """Test items (item_id, text) as rows of blocks, the number of blocks, and the bytes of all texts."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size["n"] // per_block))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")
    return rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "text")).alias("tests")), n, size["bytes"]


def with_blocks(index: DataFrame, blocks: DataFrame, n: int, size: int) -> DataFrame:
    """Each shard beside each block of items.

    Items of at most BROADCAST bytes of text are broadcast.  Beyond that, shards and items are
    shuffled, and a second key spreads the shards over all tasks.
    """
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if size <= BROADCAST:
        return index.join(F.broadcast(blocks), "block")
    spread = partitions(index.sparkSession)
    index = index.withColumn("deal", F.pmod(F.xxhash64("shard"), F.lit(spread)))
    blocks = blocks.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    return index.join(blocks, ["block", "deal"]).drop("deal")


def _windows(tests: list[dict], window: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows of all items: item names, the item of each window, and a matrix of hashes (short windows end in 0)."""
    names = [t["item_id"] for t in tests]
    hashes, counts = scan([t["text"].encode() for t in tests], ALNUM)
    stops = np.cumsum(counts)
    owner, rows = [], []
    for i, (n, stop) in enumerate(zip(counts.tolist(), stops.tolist())):
        words = hashes[stop - n : stop]
        if n >= window:
            rows.append(np.lib.stride_tricks.sliding_window_view(words, window))
            owner += [i] * (n - window + 1)
        elif n:
            rows.append(np.pad(words, (0, window - n))[None])
            owner.append(i)
    return names, np.array(owner, np.int64), np.concatenate(rows) if rows else np.zeros((0, window), np.uint64)


def phrase_matches(spark: SparkSession, path: str, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stretches of documents that equal a window of an item.

    A window is `window` words of an item in a row, or the whole item if it has fewer words.
    One row per shard, slot (place of the document in the shard) and block of items: spans
    (from, to) in words of the document, joined where they overlap, and the items found.
    """
    blocks, n, size = item_blocks(items)
    index = spark.read.schema(schema_of()).parquet(path).drop("doc_ids")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                if known.get("block") != row["block"]:
                    known = {"block": row["block"], "windows": _windows(row["tests"], window)}
                names, owner, rows = known["windows"]
                shard = Shard(row["terms"], row["ends"], row["postings"], row["n_words"])
                used = rows != 0
                place = shard.find(rows.ravel()).reshape(rows.shape)
                here = np.flatnonzero(((place >= 0) | ~used).all(1))
                begins, ends, item = [], [], []
                for w in here.tolist():
                    terms = place[w][used[w]]
                    starts = shard.phrase(terms)
                    begins.append(starts)
                    ends.append(starts + len(terms))
                    item.append(np.full(len(starts), owner[w]))
                if not begins or not sum(map(len, begins)):
                    continue
                begin, end, item = np.concatenate(begins), np.concatenate(ends), np.concatenate(item)
                slot = np.searchsorted(shard.stops, begin, "right")
                order = np.lexsort((begin, slot))
                begin, end, item, slot = begin[order], end[order], item[order], slot[order]
                reach = np.maximum.accumulate(end)  # documents follow each other, so their spans do not mix
                fresh = np.append(True, (begin[1:] > reach[:-1]) | (slot[1:] != slot[:-1]))
                a, b = begin[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(begin) - 1)]
                of = slot[fresh]
                base = np.concatenate([[0], shard.stops[:-1]])
                out: dict[int, tuple[list, set]] = {}
                for s, x, y in zip(of.tolist(), (a - base[of]).tolist(), (b - base[of]).tolist()):
                    out.setdefault(s, ([], set()))[0].append({"a": x, "b": y})
                for s, i in set(zip(slot.tolist(), item.tolist())):
                    out[s][1].add(names[i])
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "slot": s, "spans": spans, "items": [x for x in found if x is not None]} for s, (spans, found) in out.items()],
                    FOUND_ARROW,
                )

    return with_blocks(index, blocks, n, size).mapInArrow(search, FOUND)


FOUND_ARROW = pa.schema(
    [
        ("shard", pa.int64()), ("slot", pa.int32()),
        ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string())),
    ]
)


def documents_of(spark: SparkSession, path: str, ids: str = "long") -> DataFrame:
    """shard, slot, doc_id, n_words of each document of the index."""
    rows = spark.read.schema(schema_of(ids)).parquet(path).select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("slot", "d"))
    return rows.select("shard", "slot", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))


def proximity_matches(spark: SparkSession, path: str, words: list[str], width: int) -> DataFrame:
    """doc_id, first, last: the shortest stretches of at most `width` words that hold all the given words."""
    wanted = scan([" ".join(words).encode()], ALNUM)[0]
    index = spark.read.schema(schema_of()).parquet(path)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["terms"], row["ends"], row["postings"], row["n_words"])
                place = shard.find(wanted)
                if not len(place) or (place < 0).any():
                    continue
                first, last = shard.near(place, width)
                slot = np.searchsorted(shard.stops, first, "right")
                base = np.concatenate([[0], shard.stops[:-1]])[slot]
                docs = pa.array([row["doc_ids"][s] for s in slot.tolist()], pa.int64())
                yield pa.record_batch([docs, pa.array(first - base), pa.array(last - base)], ["doc_id", "first", "last"])

    return index.mapInArrow(search, "doc_id long, first long, last long")


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, each counted once."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        fresh = F.greatest(x["b"] - F.greatest(x["a"], acc["upto"]), F.lit(0)).cast("long")
        return F.struct(F.greatest(acc["upto"], x["b"]).alias("upto"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, path: str | None = None, window: int = WINDOW, ids: str = "long") -> DataFrame:
    """One row per row of `docs`: doc_id (of type `ids`), n_words, n_hit, n_items, items (sorted), contaminated.

    A word is hit if an occurrence of a window covers it; a document is contaminated if at least
    a twentieth of its words are hit.  Without documents the result is empty; without items
    nothing is hit.
    """
    spark = prepare(docs.sparkSession)
    path = build_index(docs, path or new_path(spark, "index"), ids)
    hits = phrase_matches(spark, path, items, window).groupBy("shard", "slot").agg(
        _covered(F.flatten(F.collect_list("spans"))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    rows = documents_of(spark, path, ids).join(hits, ["shard", "slot"], "left")
    rows = rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
