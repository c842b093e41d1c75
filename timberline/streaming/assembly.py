"""Multi-line assembly on a stream, with an end to every event.

Four tables under a path hold what is known, one folder a micro-batch, which a batch that is run
again replaces:

``recent``
    lines that another line may still come before, written anew in each batch;
``settled``
    lines whose event is known, each written once;
``state``
    one row a source: its open event, since which batch there are lines of it, up to which number its
    events are written, and when it was seen;
``events``
    the events that ended in the batch.

What goes from batch to batch is bounded by the wait and by the number of sources, also for a source that
never has a start line: its lines are settled, and read again only when its event ends.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from timberline.functions.extract import matches
from timberline.operators.multiline import join_lines, mark_events
from timberline.sources.channels import number_lines

TABLES = ("recent", "settled", "state")
STATE = "open_start long, since long, upto long, reached long, seen timestamp, newest timestamp"
NO_EDGE = (1 << 63) - 1


@dataclass(frozen=True)
class Assembly:
    """How lines become events.

    ``time`` is the column of a line's arrival.  Without it, lines must arrive in ``seq`` order, and an event ends
    with the next start line.  With it, a line may come ``wait`` later than lines behind it and takes its
    place; an event ends when its lines and all lines up to the next start, or to the end of a source that
    is quiet, are older than the newest line of the stream by ``wait``.  A line that comes when its event is
    written is an event of its own.  A source that was not seen for ``forget`` leaves the state.
    """

    path: str
    source: str
    seq: str
    continuation: str
    time: str | None = None
    wait: str = "10 minutes"
    forget: str = "1 day"

    def _folder(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def _state(self, spark: SparkSession, batch: int) -> DataFrame:
        schema = f"`{self.source}` string, {STATE}"
        return spark.read.schema(schema).parquet(self._folder("state", batch)) if batch >= 0 else spark.createDataFrame([], schema)

    def _recent(self, spark: SparkSession, batch: int, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(self._folder("recent", batch)) if batch >= 0 else spark.createDataFrame([], schema)

    def _settled(self, spark: SparkSession, first: int, last: int, schema: T.StructType) -> DataFrame:
        folders = [self._folder("settled", i) for i in range(first, last + 1)]
        return spark.read.schema(schema).option("basePath", f"{self.path}/settled").parquet(*folders).select(*schema.names)

    def _edged(self, lines: DataFrame, newest: dt.datetime | None) -> DataFrame:
        """With the first line of the source that others may still come before, as `edge`; lines in front of it are settled."""
        if self.time is None or newest is None:
            return lines.withColumn("edge", F.lit(NO_EDGE))
        young = F.coalesce(F.col(self.time) > F.lit(newest) - F.expr(f"INTERVAL {self.wait}"), F.lit(False))
        edges = lines.groupBy(self.source).agg(F.coalesce(F.min(F.when(young, F.col(self.seq))), F.lit(NO_EDGE)).alias("edge"))
        return lines.join(edges, self.source)

    def write(self, batch: DataFrame, number: int) -> None:
        """One micro-batch."""
        spark, source, seq = batch.sparkSession, self.source, self.seq
        if "block_start" in batch.columns:
            batch = number_lines(batch, seq)
        columns, old = batch.columns, self._state(spark, number - 1)
        lines = batch.withColumn(source, F.coalesce(source, F.lit(""))).unionByName(self._recent(spark, number - 1, batch.schema))
        lines = lines.withColumn("_begins", ~matches(F.col("message"), self.continuation)).persist()
        newest = old.agg(F.max("newest")).first()[0]
        if self.time is not None:
            newest = max((t for t in (lines.agg(F.max(self.time)).first()[0], newest) if t is not None), default=None)

        placed = lines.join(old.select(source, "upto"), source, "left")
        is_late = F.coalesce(F.col(seq) <= F.col("upto"), F.lit(False))
        late = placed.where(is_late).select(*columns, F.col(seq).alias("_event"))
        live = placed.where(~is_late).select(*columns, "_begins")
        live = self._edged(live, newest)
        recent = live.where(F.col(seq) >= F.col("edge"))
        recent.select(*columns).write.mode("overwrite").parquet(self._folder("recent", number))
        marked = mark_events(live.where(F.col(seq) < F.col("edge")).select(*columns), source, seq, self.continuation, open_events=old)
        marked.write.mode("overwrite").parquet(self._folder("settled", number))
        marked = self._settled(spark, number, number, marked.schema)

        next_lines = recent.groupBy(source).agg(F.min_by("_begins", seq).alias("begins"))
        new = marked.groupBy(source).agg(F.max("_event").alias("last"), F.max(seq).alias("reached_now"))
        came = lines.select(source).distinct().withColumn("came", F.lit(True))
        now = old.join(new, source, "full").join(next_lines, source, "full").join(came, source, "full")
        now = now.withColumn("open_now", F.coalesce("last", "open_start"))
        # with an open event, `begins` is NULL where nothing of the source is recent
        ends = F.coalesce("begins", F.lit(self.time is not None))
        now = now.withColumn("stays", F.col("open_now").isNotNull() & ~ends).withColumn("reached_all", F.greatest("reached", "reached_now"))
        goes_on = F.col("stays") & F.col("open_now").eqNullSafe(F.col("open_start"))
        now = now.withColumns(
            {
                "goes_on": goes_on,
                "since_now": F.when(goes_on, F.col("since")).when(F.col("stays"), number),
                "upto_now": F.when(F.col("stays"), F.col("open_now") - 1).when(F.col("open_now").isNotNull(), F.col("reached_all")),
                "seen_now": F.when(F.col("came"), F.lit(newest).cast("timestamp")).otherwise(F.col("seen")),
            }
        ).persist()
        state = now.select(
            source, F.when(F.col("stays"), F.col("open_now")).alias("open_start"), F.col("since_now").cast("long").alias("since"), F.greatest("upto", "upto_now").alias("upto"),
            F.col("reached_all").alias("reached"), F.col("seen_now").alias("seen"), F.lit(newest).cast("timestamp").alias("newest"),
        )
        if newest is not None:
            stale = F.col("seen") < F.lit(newest) - F.expr(f"INTERVAL {self.forget}")
            state = state.where(F.col("open_start").isNotNull() | ~F.coalesce(stale, F.lit(False)))
        state.write.mode("overwrite").parquet(self._folder("state", number))

        ending = now.where("open_start IS NOT NULL AND NOT goes_on").agg(F.min("since")).first()[0]
        if ending is not None:
            marked = self._settled(spark, ending, number, marked.schema)
        done = now.select(source, F.col("upto").alias("_upto"), F.when(F.col("stays"), F.col("open_now")).alias("_open"))
        done = marked.join(done, source).where("(_upto IS NULL OR _event > _upto) AND (_open IS NULL OR _event <> _open)")
        events = join_lines(done.select(*marked.columns).unionByName(late), source, seq)
        events.write.mode("overwrite").parquet(self._folder("events", number))

        needed = old.agg(F.min("since")).first()[0]
        for table in TABLES:
            self._forget(spark, table, min(number - 1, needed) if table == "settled" and needed is not None else number - 1)
        lines.unpersist()
        now.unpersist()

    def forget_events(self, spark: SparkSession, last: int) -> None:
        """Remove the events of the batches up to ``last``, where something else has them."""
        self._forget(spark, "events", last + 1)

    def _forget(self, spark: SparkSession, table: str, first: int) -> None:
        """Remove the folders that no batch, this one run again included, reads any more."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in fs.listStatus(root):
            name = x.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) < first:
                fs.delete(x.getPath(), True)

    def start(self, lines: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        writer = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.write)
        return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()

    def ended(self, spark: SparkSession) -> DataFrame:
        """The events that have ended so far."""
        return spark.read.parquet(f"{self.path}/events").drop("batch")

    def batch(self, spark: SparkSession, number: int) -> DataFrame:
        """The events that ended in a batch."""
        return spark.read.parquet(self._folder("events", number))

    def opened(self, spark: SparkSession, last: int) -> DataFrame:
        """The events that are open after batch ``last``, as if the stream ended there."""
        state = self._state(spark, last)
        schema = spark.read.parquet(self._folder("settled", last)).schema
        recent = self._recent(spark, last, T.StructType([f for f in schema.fields if f.name != "_event"]))
        rest = mark_events(recent, self.source, self.seq, self.continuation, open_events=state)
        since = state.agg(F.min("since")).first()[0]
        if since is not None:
            held = self._settled(spark, since, last, schema).join(state.select(self.source, "open_start"), self.source)
            rest = rest.unionByName(held.where("_event = open_start").select(*schema.names))
        return join_lines(rest, self.source, self.seq)

    def finished(self, spark: SparkSession, last: int) -> DataFrame:
        """All events, as if the stream ended with batch ``last``."""
        return self.ended(spark).unionByName(self.opened(spark, last))
