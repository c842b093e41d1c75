"""Multi-line assembly: continuation lines join the event before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.extract import matches

CHUNK = 1 << 16
#: Chunks whose summaries are looked through together.
GROUP = 1 << 12


def mark_events(
    df: DataFrame, source: str, seq: str, continuation: str, message: str = "message", chunk: int = CHUNK, open_events: DataFrame | None = None
) -> DataFrame:
    """The lines with ``_event``, the sequence number of the line that starts their event.

    ``seq`` orders the lines of a source; a line without one is an error, since its place
    is not known.  A running window per source would put a busy source into one task, so
    each source is cut into chunks of ``chunk`` sequence numbers.  Inside a chunk a window finds
    the start line; lines before the first start of their chunk take the last start of the
    chunks before, found on one summary row per chunk and, above those, one per group of
    chunks.  Lines before all starts belong to the open event of their source (``open_events``:
    the source and ``open_start``), else to an event that the first of them starts.
    """
    missing = F.raise_error(F.lit(f"multi-line assembly needs {seq} in every line"))
    df = df.withColumn(seq, F.coalesce(F.col(seq), missing.cast(df.schema[seq].dataType)))
    lines = df.withColumns(
        {
            source: F.coalesce(source, F.lit("")),
            "_chunk": F.floor(F.col(seq) / chunk),
            "_start": F.when(~matches(F.col(message), continuation), F.col(seq)),
        }
    )
    chunks = lines.groupBy(source, "_chunk").agg(F.max("_start").alias("_last"), F.min(seq).alias("_first"))
    chunks = chunks.withColumn("_group", F.floor(F.col("_chunk") / GROUP))
    groups = chunks.groupBy(source, "_group").agg(F.max("_last").alias("_glast"), F.min("_first").alias("_gfirst"))
    before = Window.partitionBy(source).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(source)
    first = F.min("_gfirst").over(whole)
    if open_events is not None:
        groups = groups.join(open_events.select(source, "open_start"), source, "left")
        first = F.coalesce("open_start", first)
    groups = groups.select(source, "_group", F.coalesce(F.max("_glast").over(before), first).alias("_before"))
    inside = Window.partitionBy(source, "_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.withColumn("_found", F.max("_last").over(inside)).join(groups, [source, "_group"])
    carry = carry.select(source, "_chunk", F.coalesce("_found", "_before").alias("_carry"))
    in_chunk = Window.partitionBy(source, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_own", F.max("_start").over(in_chunk)).join(carry, [source, "_chunk"], "left")
    return lines.withColumn("_event", F.coalesce("_own", "_carry")).drop("_own", "_carry", "_chunk", "_start")


def join_lines(lines: DataFrame, source: str, seq: str, message: str = "message") -> DataFrame:
    """One row per event of marked lines: the first line's columns, with all its lines in ``message``."""
    others = [c for c in lines.columns if c not in (source, seq, message, "_event")]
    first = [F.min_by(c, seq).alias(c) for c in others]
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(message).alias("m"))))
    return (
        lines.groupBy(source, F.col("_event").alias(seq))
        .agg(*first, F.count("*").alias("n_lines"), ordered.alias("_lines"))
        .withColumn(message, F.array_join("_lines.m", "\n"))
        .drop("_lines")
    )


def assemble(
    df: DataFrame, source: str, seq: str, continuation: str, message: str = "message", chunk: int = CHUNK
) -> DataFrame:
    """One row per event: the first line's columns, with all its lines in ``message``.

    Every line is shuffled twice, on (source, chunk) and on the event, and never on the source
    alone.  Without a start line at all, the first line of a source starts an event.
    """
    return join_lines(mark_events(df, source, seq, continuation, message, chunk), source, seq, message)


def split_lines(df: DataFrame, message: str = "message") -> DataFrame:
    """One row per line of a multi-line message, numbered from 0."""
    names = [c for c in df.columns if c != message]
    return df.select(*names, F.posexplode(F.split(message, "\n")).alias("line_no", message))
