"""Streaming jobs; each uses the batch functions on a stream.

Every job has a checkpoint folder, and batch-wise sinks write one folder per
micro-batch in overwrite mode, so a batch that is run again after a lost
executor or driver replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from timberline.operators import syslog
from timberline.operators.panels import histogram
from timberline.plans import indexing
from timberline.sources.channels import number_lines
from timberline.sources.store import EventStore
from timberline.streaming.assembly import Assembly


def queue(spark: SparkSession, servers: str, topic: str, per_batch: int = 1_000_000) -> DataFrame:
    """Raw events from a broker topic as the bronze columns (needs the Kafka package)."""
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", per_batch)
        .load()
    )
    body = F.from_json(F.col("value").cast("string"), "type string, message string, host string")
    return stream.select(
        body.alias("e"), F.col("timestamp").alias("received_at"), F.col("offset").alias("ingest_seq")
    ).select("e.*", "received_at", "ingest_seq", F.array().cast("array<string>").alias("tags"))


def _trigger(interval: str | None) -> dict:
    return {"processingTime": interval} if interval else {"availableNow": True}


def land(events: DataFrame, path: str, checkpoint: str, by: list[str], interval: str | None = None) -> StreamingQuery:
    """Append a stream to a plain table partitioned ``by`` columns, such as raw events by type."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*by).outputMode("append").trigger(**_trigger(interval)).start()


def land_indexed(events: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a stream of routed events to the event store at ``path``.

    Late events go to their own day; nothing is dropped.  Maintenance of the store can run meanwhile.
    """
    return EventStore(events.sparkSession, path).stream(events, checkpoint, interval)


def _assemblies(path: str, source: str, time: str | None, wait: str) -> dict[str, Assembly]:
    return {t: Assembly(f"{path}/lines/{t}", source, "ingest_seq", c, time, wait) for t, c in indexing.MULTILINE.items()}


def index_stream(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    source: str = "host",
    interval: str | None = None,
    time: str | None = None,
    wait: str = "10 minutes",
    **job: object,
) -> StreamingQuery:
    """The whole indexing job on a stream of raw channel events of all types, into the event store at ``path``.

    Lines of the types that are assembled wait for their event (``time``, ``wait``: see ``Assembly``); all
    others are parsed in the micro-batch that brings them.  ``job`` goes to ``index_events``.
    ``finish_index`` adds the events that are open at the end.  The lines of a micro-batch are kept, and its assembled
    events stored by themselves, until the event store has it.
    """
    kept: list[DataFrame] = []

    def release() -> None:
        while kept:
            kept.pop().unpersist()

    def made(batch: DataFrame, number: int) -> DataFrame:
        release()
        batch = (number_lines(batch) if "block_start" in batch.columns else batch).persist()
        kept.append(batch)
        done = {}
        for kind, assembly in _assemblies(path, source, time, wait).items():
            assembly.write(batch.where(F.col("type") == kind), number)
            done[kind] = assembly.batch(batch.sparkSession, number).drop("n_lines")
        return indexing.index_events(batch, assembled=done, **job).drop("index_name")

    def stored(number: int) -> None:
        release()
        for assembly in _assemblies(path, source, time, wait).values():
            assembly.forget_events(raw.sparkSession, number)

    return EventStore(raw.sparkSession, path).stream(raw, checkpoint, interval, made=made, stored=stored)


def finish_index(spark: SparkSession, path: str, last_batch: int, source: str = "host", **job: object) -> None:
    """Close what is open after the last batch of an indexing stream and add it to the store."""
    opened = {k: a.opened(spark, last_batch).drop("n_lines") for k, a in _assemblies(path, source, None, "").items()}
    events = indexing.index_events({}, assembled=opened, **job).drop("index_name")
    EventStore(spark, path).write(events)


def live_histogram(
    events: DataFrame,
    path: str,
    checkpoint: str,
    width: str = "5m",
    late: str = "10 minutes",
    interval: str | None = "5 minutes",
) -> StreamingQuery:
    """Bucket counts per series, updated each trigger.

    Changed buckets are written per micro-batch; ``current_histogram`` reads the
    newest count of each bucket.  Batches older than ``late`` hold closed buckets only.
    """
    counts = histogram(events.withWatermark("event_ts", late), width)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**_trigger(interval)).start()


def current_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("series", "bucket").agg(F.max_by("n", "batch").alias("n"))


def assemble_stream(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    source: str,
    seq: str,
    continuation: str,
    interval: str | None = None,
    time: str | None = None,
    wait: str = "10 minutes",
) -> StreamingQuery:
    """Multi-line assembly on a stream of lines; see ``Assembly`` for when events end.

    Lines of a channel stream are numbered as they are read.  ``finish_assembly`` closes the open events.
    """
    return Assembly(path, source, seq, continuation, time, wait).start(lines, checkpoint, interval)


def finish_assembly(
    spark: SparkSession, path: str, last_batch: int, source: str, seq: str, continuation: str
) -> DataFrame:
    """The assembled events, those that are still open after the last batch included."""
    return Assembly(path, source, seq, continuation).finished(spark, last_batch)


def alert_stream(events: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append an alert row for every canary line."""
    found = syslog.alerts(syslog.find_canary(events))
    writer = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**_trigger(interval)).start()
