"""Shared folders, packed numpy columns and word hashes for the operators beside it."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch, so that a worker holds a few megabytes of text at a time.
BATCH_ROWS = 1000
#: Bytes of text that the numpy scanner looks at in one go.
SCAN_BYTES = 1 << 21


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: UTC, re-planning at run time, small Arrow batches."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset, as in a local test, a folder of this machine is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="timberline-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/timberline-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors.

    The folder stays until its owner removes it, since the result is read lazily.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MEMOS: list[dict] = []


def memo() -> dict:
    """What Python workers remember for one operator, which only saves time."""
    _MEMOS.append({})
    return _MEMOS[-1]


def forget_others(own: dict | None = None) -> None:
    """Empty the other operators' memos in this Python worker and give their memory back.

    A worker serves the tasks of all stages; it remembers for one operator at a time, so what it holds does not add up.
    """
    others = [x for x in _MEMOS if x and x is not own]
    for x in others:
        x.clear()
    if others:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not glibc
            ctypes.CDLL(None).malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, NULL as empty."""
    return [b"" if x is None else x for x in column(batch, name).cast(pa.binary()).to_pylist()]


def binaries(values: Iterable[bytes]) -> pa.Array:
    return pa.array(list(values), pa.binary())


def chunks(items: list[bytes], limit: int = SCAN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with at most `limit` bytes, or one longer text."""
    start, size = 0, 0
    for i, item in enumerate(items):
        if size and size + len(item) > limit:
            yield start, i
            start, size = i, 0
        size += len(item) + 1
    if start < len(items):
        yield start, len(items)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public SplitMix64 generator: spreads all bits of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _weights(n: int) -> np.ndarray:
    """Odd 64-bit factors for byte positions 0..n-1."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


WEIGHTS = _weights(256)

#: Byte tables for `scan`: 0 ends a word, every other value is the byte (A-Z as a-z) plus one.
_LOWER = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
#: Words between ASCII white space.
SPACED = np.array([0 if b == 0x20 or 9 <= b <= 13 else _LOWER[b] + 1 for b in range(256)], np.uint16)
#: Words of ASCII letters and digits and everything beyond ASCII.
ALNUM = np.array([_LOWER[b] + 1 if b >= 128 or 97 <= _LOWER[b] <= 122 or 48 <= b <= 57 else 0 for b in range(256)], np.uint16)


def scan(items: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the number of words of each text.

    64-bit multilinear hashes: equal words are equal; two different words agree with a
    probability near 2**-60.
    """
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in chunks(items):
        part = items[a:b]
        mapped = table[np.frombuffer(b" ".join(part) + b" ", np.uint8)]
        inside = mapped != 0
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        begins, lengths = edges[0::2], edges[1::2] - edges[0::2]
        stops = np.cumsum([len(x) + 1 for x in part])
        counts.append(np.diff(np.searchsorted(begins, stops), prepend=0))
        if not len(begins):
            continue
        first = np.cumsum(lengths) - lengths
        place = np.arange(lengths.sum()) - np.repeat(first, lengths)
        longest = int(lengths.max())
        factor = WEIGHTS if longest <= len(WEIGHTS) else _weights(longest)
        with np.errstate(over="ignore"):
            values = factor[place] * mapped[inside].astype(np.uint64)
            hashes.append(mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64)))
    return np.concatenate(hashes), np.concatenate(counts)
