"""Vector code compression: product codes with integer codebooks, nearest entries by slice-and-intersect bitmasks.

A vector is cut into equal parts; each part position has a codebook.  For each dimension of a
codebook its coordinates are sorted, and before each sorted place stands the mask of the entries
so far.  The distance to one guessed entry is the initial radius: it selects a range of places
per dimension, two prefix masks give the entries in that range, and the ranges' masks ANDed
over the dimensions hold every entry within the radius, the nearest and its ties among them.  Only
these are measured.  All arithmetic is in integers, so results do not depend on the order of rows.

Each round is one pass over the stored vectors.  A task adds up its parts per entry, and only
these sums (entries x components, whatever the rows) are shuffled and come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import column, prepare, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
WORD = 64


class Slices:
    """One codebook (entries x width) with its sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, width = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.places = np.take_along_axis(entries, order, axis=0)
        bits = np.zeros((n, -(-n // WORD)), np.uint64)
        bits[np.arange(n), np.arange(n) // WORD] = np.uint64(1) << (np.arange(n) % WORD).astype(np.uint64)
        self.masks = np.zeros((width, n + 1, bits.shape[1]), np.uint64)
        for j in range(width):
            self.masks[j, 1:] = np.bitwise_or.accumulate(bits[order[:, j]], axis=0)
        spread = self.places[-1] - self.places[0]
        self.widest = int(np.argmax(spread)) if width else 0
        self.by_widest = order[:, self.widest] if width else np.zeros(n, np.int64)

    def candidates(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows x words) of the entries whose coordinates all lie within the radius."""
        out = np.full((len(parts), self.masks.shape[2]), np.uint64(2**64 - 1))
        for j in range(parts.shape[1]):
            low = np.searchsorted(self.places[:, j], parts[:, j] - radius, "left")
            high = np.searchsorted(self.places[:, j], parts[:, j] + radius, "right")
            out &= self.masks[j, high] ^ self.masks[j, low]
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, the lower index on ties, and the squared distance."""
        n = len(self.entries)
        if not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        at = np.searchsorted(self.places[:, self.widest], parts[:, self.widest])
        guess = self.by_widest[np.minimum(at, n - 1)]
        reach = ((parts - self.entries[guess]) ** 2).sum(axis=1)
        masks = self.candidates(parts, np.sqrt(reach).astype(np.int64) + 1)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        chosen = np.zeros(len(parts), np.int64)
        for e in range(n):
            rows = np.flatnonzero(masks[:, e // WORD] >> np.uint64(e % WORD) & np.uint64(1))
            gap = ((parts[rows] - self.entries[e]) ** 2).sum(axis=1)
            closer = gap < best[rows]
            best[rows[closer]], chosen[rows[closer]] = gap[closer], e
        return chosen, best


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The integer vectors of a batch, zeros behind the shorter ones; an error where distances could pass 64 bits."""
    lists = column(batch, "q")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    if len(values) and width and max(int(values.max()), -int(values.min())) > 2**30 // int(np.ceil(np.sqrt(width))):
        raise ValueError("vector components are too large: their squared distances may not fit in 64 bits")
    return out


@dataclass
class Codebooks:
    """parts x (entries, components of a part); `width` is the length of the vectors, padded to equal parts."""

    books: list[np.ndarray]
    width: int
    scale: int

    @property
    def sha256(self) -> str:
        """Of all components as decimal text, by part, entry and position."""
        text = ",".join(str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        picked = bytes.fromhex(code)
        return [x / self.scale for book, e in zip(self.books, picked) for x in book[e].tolist()]

    def _assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = np.split(rows, len(self.books), axis=1)
        found = [Slices(book).nearest(part) for book, part in zip(self.books, split)]
        return np.stack([x[0] for x in found], axis=1), np.stack([x[1] for x in found], axis=1)

    def sums(self, vectors: DataFrame) -> DataFrame:
        """cell, amount: the parts of each entry added up, and, in the cells after those, their numbers."""
        parts, entries = len(self.books), len(self.books[0])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, entries, self.width // parts), np.int64)
            count = np.zeros((parts, entries), np.int64)
            for batch in batches:
                rows = matrix(batch, self.width)
                chosen, _ = self._assign(rows)
                for p, part in enumerate(np.split(rows, parts, axis=1)):
                    np.add.at(total[p], chosen[:, p], part)
                    count[p] += np.bincount(chosen[:, p], minlength=entries)
            amount = np.concatenate([total.ravel(), count.ravel()])
            cell = np.flatnonzero(amount)
            yield pa.record_batch([pa.array(cell), pa.array(amount[cell])], ["cell", "amount"])

        tasks = vectors.select("q").mapInArrow(add, "cell long, amount long")
        return tasks.groupBy("cell").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))

    def moved(self, vectors: DataFrame) -> Codebooks:
        """One round: each entry becomes the mean of its parts, floored; an unused one stays."""
        parts, entries, part = len(self.books), len(self.books[0]), self.width // len(self.books)
        cells = [0] * (parts * entries * (part + 1))
        for row in self.sums(vectors).collect():  # at most entries x (components + parts), whatever the rows
            cells[row["cell"]] = int(row["amount"])
        books = []
        for p, old in enumerate(self.books):
            book = old.copy()
            for e in range(entries):
                start, n = (p * entries + e) * part, cells[parts * entries * part + p * entries + e]
                if n:
                    book[e] = [x // n for x in cells[start : start + part]]
            books.append(book)
        return Codebooks(books, self.width, self.scale)

    def encode(self, vectors: DataFrame) -> DataFrame:
        """vec_id, label, code (two hex digits a part), error (squared distance, in steps of 1 / scale)."""
        kept = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen, gaps = self._assign(matrix(batch, self.width))
                codes = [bytes(x).hex() for x in chosen.astype(np.uint8)]
                columns = [column(batch, "vec_id"), column(batch, "label"), pa.array(codes, pa.string()), pa.array(gaps.sum(axis=1))]
                yield pa.record_batch(columns, ["vec_id", "label", "code", "error"])

        return vectors.mapInArrow(run, f"vec_id {kept[0]}, label {kept[1]}, code string, error long")


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, q: floor(scale * x) of the vectors without NULL and non-finite components, written once."""
    prepare(df.sparkSession)
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False)))
    kept = df.where(F.col(vector).isNotNull() & finite)
    too_large = F.raise_error(F.lit("a vector component is too large for integer codes")).cast("long")
    steps = F.transform(x, lambda v: F.when(F.abs(v) < 2**62 / scale, F.floor(v * scale)).otherwise(too_large))
    return stored(kept.select("vec_id", "label", steps.alias("q")), "vectors")


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of integer vectors; they start from the vectors with the smallest ids.  None without vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not first:
        return None
    longest = vectors.agg(F.max(F.size("q"))).first()[0]
    width = -(-longest // parts) * parts
    start = np.array([r["q"] + [0] * (width - len(r["q"])) for r in first], np.int64).reshape(len(first), width)
    books = Codebooks(np.split(start, parts, axis=1), width, scale)
    for _ in range(rounds):
        books = books.moved(vectors)
    return books


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of a table (vec_id, embedding, label).

    Rows whose vector is NULL or holds NULL or non-finite components are dropped.  Repeated ids
    and equal vectors are rows of their own; codebooks start from the smallest ids, NULL last, equal
    ids by their components; fewer rows than entries make smaller codebooks, and an unused entry
    stays.  Vectors of different lengths, or not of a multiple of `parts`, count as followed by zeros.
    Empty vectors have the error 0 where all are empty.  Components whose squared distances may
    pass 64 bits are an error.  Labels of NULL are one label.  Other columns do not matter.
    """
    vectors = integer_vectors(df, scale=scale)
    books = fit(vectors, parts, entries, rounds, scale)
    if books is None:
        empty = vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select("*", F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = stored(books.encode(vectors), "codes")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
