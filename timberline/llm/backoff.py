"""Stupid-backoff language-model scores of all documents against all other documents.

The n-gram counts of the whole corpus are a table partitioned by n-gram hash; each document's
n-grams are joined to it and the logarithms summed per document.  Rows of that join are packed:

1. Documents become blocks of about a million words: hashes of the different words and the
   word numbers in a row, in a table bucketed by block.
2. A block sends each of its different n-grams once, with its count there, to the part of the
   count table that the hash falls into.  A frequent n-gram is one entry a block.
3. A part adds up the counts of equal n-grams and answers each block in the block's own order.
4. A block puts the answers beside its n-grams, takes off what the document itself counts, and
   sums the scores of each document.

So a document is scored by the counts of all *other* documents: with its own counts included,
every one of its n-grams would be known and nothing would ever back off.

Words are runs of characters other than ASCII white space, A-Z as a-z.  N-grams are hashes of
SPARE bits more than it takes to number all of the corpus, 64 at most, so that about one in
2**SPARE of them shares its hash with another one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import SPACED, binaries, column, mix64, new_path, partitions, prepare, scan, texts

BLOCK_WORDS = 1 << 20
ORDER = 3
BACKOFF = 0.4
SPARE = 24
BLOCKS = "block long, doc_ids array<long>, n_words array<long>, words binary, stream binary"


def make_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents (doc_id, text) as blocks; NULL and empty texts have no words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            words, stream, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            return pa.record_batch(
                [
                    pa.array([task << 24 | made], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int64())),
                    binaries([words[order].tobytes()]), binaries([planes(rank[stream])]),
                ],
                ["block", "doc_ids", "n_words", "words", "stream"],
            )

        for batch in batches:
            found, n = scan(texts(batch), SPACED)
            ids += column(batch, "doc_id").to_pylist()
            hashes.append(found)
            counts.append(n)
            if sum(map(len, hashes)) >= block_words:
                yield flush()
                made, ids, hashes, counts = made + 1, [], [], []
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(build, BLOCKS)


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second bytes, and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Words:
    """The words of a block: their hashes, the document of each, and the words before it."""

    def __init__(self, row: dict) -> None:
        self.counts = np.array(row["n_words"], np.int64)
        self.hashes = np.frombuffer(row["words"], np.uint64)[from_planes(row["stream"], np.uint32)]
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.before = np.arange(len(self.hashes)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)

    def grams(self, order: int, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For n from 1: n, hashes of the n-grams, the places where they end."""
        rolling = np.zeros(len(self.hashes), np.uint64)
        for n in range(1, order + 1):
            # the hash of the n words that end here is that of the n - 1 words before and this word
            previous = np.concatenate([np.zeros(1, np.uint64), rolling[:-1]]) if n > 1 else rolling
            with np.errstate(over="ignore"):
                rolling = mix64(previous * np.uint64(0xD1342543DE82EF95) + self.hashes + np.uint64(n))
            at = np.flatnonzero(self.before >= n - 1)
            yield n, rolling[at] >> np.uint64(64 - bits), at


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time; what Arrow holds on to is given back in between."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            pa.default_memory_pool().release_unused()


def hash_bits(total: int, order: int) -> int:
    return min(64, SPARE + (total * order).bit_length())


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, log_score (natural), mean_log_score.

    A word that follows its n - 1 words in other documents costs log(count / count of those
    words), with the largest n up to `order`; each shorter n costs log(backoff) more.  A word
    that no other document holds counts as one half of an occurrence.  A document without words
    has the score 0 and no mean.  Repeated rows are other documents.  Further columns are not read.
    """
    spark = prepare(docs.sparkSession)
    parts = partitions(spark)
    name = f"timberline_blocks_{uuid.uuid4().hex}"
    writer = make_blocks(docs, block_words).write.bucketBy(parts, "block").option("compression", "zstd")
    writer.option("path", new_path(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.select(F.explode("n_words").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    bits = hash_bits(total, order)
    bounds = np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for n, hashes, _ in Words(row).grams(order, bits):
                keys, counts = np.unique(hashes, return_counts=True)
                counts = counts.astype(np.uint32)
                cut = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).tolist()
                some = [p for p in range(parts) if cut[p] < cut[p + 1]]
                steps = (np.diff(keys[cut[p] : cut[p + 1]], prepend=np.uint64(0)) for p in some)
                yield pa.record_batch(
                    [
                        pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([n] * len(some), pa.int32()),
                        binaries(map(planes, steps)), binaries(planes(counts[cut[p] : cut[p + 1]]) for p in some),
                    ],
                    ["part", "block", "n", "keys", "counts"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[int, int, int]] = []
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in batches:
            for p, b, n, k, c in zip(*(column(batch, x).to_pylist() for x in ("part", "block", "n", "keys", "counts"))):
                asked.append((p, b, n))
                keys.append(np.cumsum(from_planes(k, np.uint64), dtype=np.uint64))
                counts.append(from_planes(c, np.uint32))
        if not asked:
            return
        stops = np.cumsum([len(k) for k in keys])
        totals = np.zeros(int(stops[-1]), np.uint64)
        for n in range(1, order + 1):  # n-grams of different n do not meet
            own = [i for i, a in enumerate(asked) if a[2] == n]
            if not own:
                continue
            every = np.concatenate([keys[i] for i in own])
            place = np.argsort(every)
            every = every[place]
            fresh = np.append(True, every[1:] != every[:-1])
            sums = np.add.reduceat(np.concatenate([counts[i] for i in own])[place].astype(np.uint64), np.flatnonzero(fresh))
            back = np.empty(len(every), np.uint64)
            back[place] = sums[np.cumsum(fresh) - 1]
            start = 0
            for i in own:
                totals[stops[i] - len(keys[i]) : stops[i]] = back[start : start + len(keys[i])]
                start += len(keys[i])
        for (p, b, n), k, stop in zip(asked, keys, stops.tolist()):
            data = binaries([planes(totals[stop - len(k) : stop])])
            yield pa.record_batch([pa.array([b], pa.int64()), pa.array([p], pa.int32()), pa.array([n], pa.int32()), data], ["block", "part", "n", "totals"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            sums = _block_scores(row, order, bits, backoff, total)
            n = pa.array(row["n_words"], pa.int64())
            yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), n, pa.array(sums)], ["doc_id", "n_words", "log_score"])

    requests = blocks.mapInArrow(ask, "part int, block long, n int, keys binary, counts binary")
    answers = requests.repartitionById(parts, "part").mapInArrow(answer, "block long, part int, n int, totals binary")
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("n", "part", "totals")).alias("answers"))
    rows = blocks.join(per_block, "block", "left").mapInArrow(settle, "doc_id long, n_words long, log_score double")
    return rows.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def _others(hashes: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For each n-gram, its count in other documents; `totals` are the counts of the different hashes in order."""
    place = np.argsort(hashes)
    ranked = hashes[place]
    number = np.empty(len(hashes), np.uint64)
    number[place] = (np.cumsum(np.append(True, ranked[1:] != ranked[:-1])) - 1).astype(np.uint64)
    own = doc.astype(np.uint64) << np.uint64(36) | number  # a document and an n-gram
    place = np.argsort(own)
    ranked = own[place]
    length = np.diff(np.append(np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])), len(ranked)))
    out = totals[number.astype(np.int64)]
    out[place] -= np.repeat(length, length)
    return out


def _block_scores(row: dict, order: int, bits: int, backoff: float, total: int) -> np.ndarray:
    """The summed score of each document of a block."""
    words = Words(row)
    doc, before = words.doc, words.before
    if not len(doc):
        return np.zeros(len(words.counts))
    answers = sorted(row["answers"] or [], key=lambda a: (a["n"], a["part"]))
    rest = np.maximum(total - words.counts, 1)[doc]
    value = shorter = np.zeros(0)
    for n, hashes, at in words.grams(order, bits):  # longer ones overrule shorter ones
        if not len(at):
            break
        totals = np.concatenate([from_planes(a["totals"], np.int64) for a in answers if a["n"] == n])
        known = np.zeros(len(doc), np.int64)
        known[at] = _others(hashes, doc[at], totals)
        if n == 1:
            value = np.log(np.maximum(known, 0.5) / rest) + np.log(backoff) * np.minimum(before, order - 1)
        else:
            hit = np.flatnonzero(known > 0)
            value[hit] = np.log(known[hit] / shorter[hit - 1]) + np.log(backoff) * (np.minimum(before[hit], order - 1) - (n - 1))
        shorter = known
    return np.bincount(doc, value, len(words.counts))
