"""Typed intake channels (batch and stream) and JSON payloads."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.extract import once
from timberline.functions.tags import no_tags

# The intake channels and how each one frames its payload.
CHANNELS = {
    "syslog": "line",
    "firewall": "line",
    "VMware": "line",
    "vCenter": "line",
    "eventlog": "json",
    "iis": "json_lines",
}


def events_of(lines: DataFrame, channel: str) -> DataFrame:
    """Stamp raw lines (``message`` and whatever else is known) as channel events."""
    have = set(lines.columns)
    return lines.select(
        F.lit(channel).alias("type"),
        "message",
        (F.col("host") if "host" in have else F.lit(None).cast("string")).alias("host"),
        (F.col("received_at") if "received_at" in have else F.current_timestamp()).alias("received_at"),
        (F.col("ingest_seq") if "ingest_seq" in have else F.lit(None).cast("bigint")).alias("ingest_seq"),
        no_tags().alias("tags"),
        *(c for c in ("source_file", "block_start") if c in have),
    )


def number_lines(lines: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """Give the lines of a channel, in the tasks that read them, their order in their file.

    It is where a line's split starts, plus the lines that the task has read before, which are
    never more than the bytes of a split.  A micro-batch of a stream is numbered when it is processed, before
    its rows are filtered or moved.
    """
    read_before = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.withColumn(seq, F.col("block_start") + read_before).drop("block_start")


def read_channel(spark: SparkSession, path: str, channel: str, stream: bool = False, **options: str) -> DataFrame:
    """A directory of text files as one typed channel, with the file of each line and its order there.

    A stream cannot number lines; it has ``block_start`` instead, from which ``number_lines`` does so in
    each micro-batch.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.options(**options).text(path)
    file, block = F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start")
    lines = events_of(lines.select(F.col("value").alias("message"), file, block), channel)
    return lines if stream else number_lines(lines)


def read_channels(spark: SparkSession, paths: Mapping[str, str], stream: bool = False) -> DataFrame:
    """All channels as one table."""
    frames = [read_channel(spark, path, channel, stream) for channel, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def decode_json(df: DataFrame, schema: str, source: str = "message") -> DataFrame:
    """Expand a JSON payload; bad payloads give NULL fields and ``json_ok`` false.

    Keys outside the schema stay reachable in ``extra`` as a variant.
    """
    record = F.from_json(F.col(source), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = once(df, "_json", record)
    names = [f.name for f in df.schema["_json"].dataType.fields if f.name != "_corrupt"]
    return df.withColumns(
        {
            **{n: F.col(f"_json.`{n}`") for n in names},
            "json_ok": F.col("_json").isNotNull() & F.col("_json._corrupt").isNull(),
            "extra": F.try_parse_json(F.col(source)),
        }
    ).drop("_json")
