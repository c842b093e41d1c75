"""Streaming queries: run over all of the table's files, then compared as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.fixtures import lines as L
from timberline.functions.search import arrived_since, by_query, pick
from timberline.functions.tags import no_tags, tags_by_type
from timberline.operators import syslog
from timberline.session import TASK_ROWS, latest, table, tidy
from timberline.sources import storage
from timberline.sources.store import EventStore
from timberline.plans.dashboards import CENTRAL
from timberline.streaming import jobs
from timberline.streaming.panel_tables import PanelTables
from timberline.suite import query
from timberline.suite.parsing import _DOC_LINES, second
from timberline.suite.storing import _FAMILY_SQL, typed_events
from timberline.suite.searching import _SERIES, CENTRAL_SQL, SECOND, log_events, named_queries


BATCHES = 4
#: Lines of a micro-batch of lines in order, about: more lines come in more batches.
LINES = 1 << 23


def _files(spark, folder, df, name):
    """Write lines as a table of files, and read it as a stream of a few micro-batches.

    The files follow the read tasks of the table, so they do not grow with it.
    """
    path = storage.shared_folder(spark, name)
    tasks = df.rdd.getNumPartitions()
    if tasks < BATCHES:
        tasks, df = BATCHES, df.repartition(BATCHES)
    df.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-tasks // BATCHES)).parquet(f"{path}/in")
    return stream, path


def _files_in_order(spark, df, name):
    """The same, with the parts written one after the other, in line order; files that a batch has read are removed.

    Lines are counted for that: to ask a planned table for its tasks would run its shuffles, and keep them.
    """
    path = storage.shared_folder(spark, name)
    ends = df.agg(F.min("ingest_seq").alias("a"), F.max("ingest_seq").alias("b"), F.count("*").alias("n")).first()
    batches = max(BATCHES, -(-ends.n // LINES))
    width = (ends.b - ends.a) // batches + 1
    part = F.floor((F.col("ingest_seq") - ends.a) / width)
    lines = -(-ends.n // batches)
    files = max(1, min(spark.sparkContext.defaultParallelism // 2, lines >> 10), -(-lines // TASK_ROWS))
    for i in range(batches):
        df.filter(part == i).repartition(files).write.option("compression", "zstd").mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("cleanSource", "delete").parquet(f"{path}/in")
    return stream, path


def _run(job):
    job.awaitTermination()
    return job


@query(
    "stream_ingest",
    f"""SELECT 'redhat' AS index_family, strftime(ts, '%Y-%m-%d') AS event_day, CASE WHEN event_id % 50 <> 0 THEN {L.PROGRAM} END AS syslog_program, count(*) AS n FROM events GROUP BY ALL""",
)
def stream_ingest(spark, folder):
    """Raw lines to the partitioned store, with the batch parser on the stream."""
    stream, path = _files(spark, folder, L.syslog_lines(spark, folder), "ingest")
    events = syslog.parse_syslog(stream.withColumn("tags", tags_by_type(F.col("type"), F.col("tags"))))
    routed = storage.route(events).select("event_ts", "source_host", "syslog_program", "msg", "tags", *storage.PARTITIONS)
    _run(jobs.land_indexed(routed, f"{path}/out", f"{path}/checkpoint"))
    out = EventStore(spark, f"{path}/out").scan()
    return out.groupBy("index_family", F.col("event_date").cast("string").alias("event_day"), "syslog_program").agg(F.count("*").alias("n"))


@query(
    "stream_histogram",
    f"""WITH {_SERIES}
    SELECT series, strftime(time_bucket(INTERVAL '5 minutes', ts), '{SECOND}') AS bucket, count(*) AS n FROM series GROUP BY ALL""",
)
def stream_histogram(spark, folder):
    events = log_events(spark, folder).withColumn("ingest_seq", F.col("event_id"))
    stream, path = _files(spark, folder, events, "histogram")
    live = by_query(stream, pick(named_queries()))
    _run(jobs.live_histogram(live, f"{path}/out", f"{path}/checkpoint", late="31 days", interval=None))
    return jobs.current_histogram(spark, f"{path}/out").withColumn("bucket", second("bucket"))



@query(
    "stream_multiline",
    """WITH l AS (SELECT event_id, 'host' || cast(user_id % 10 as varchar) AS host, event_type,
    CASE WHEN event_type IN ('error', 'view') THEN '--> ' || event_type ELSE event_type || ' ' || cast(event_id as varchar) END AS message FROM events),
    g AS (SELECT *, coalesce(max(CASE WHEN event_type NOT IN ('error', 'view') THEN event_id END) OVER (PARTITION BY host ORDER BY event_id),
    min(event_id) OVER (PARTITION BY host)) AS start FROM l)
    SELECT host, start AS ingest_seq, count(*) AS n_lines, md5(string_agg(message, chr(10) ORDER BY event_id)) AS digest FROM g GROUP BY ALL""",
)
def stream_multiline(spark, folder):
    lines = table(spark, folder, "events").select(
        F.expr(L.HOST).alias("host"),
        F.col("event_id").alias("ingest_seq"),
        F.expr(
            "CASE WHEN event_type IN ('error', 'view') THEN '--> ' || event_type ELSE event_type || ' ' || cast(event_id as string) END"
        ).alias("message"),
    )
    stream, path = _files_in_order(spark, lines, "multiline")
    job = _run(jobs.assemble_stream(stream, f"{path}/out", f"{path}/checkpoint", "host", "ingest_seq", "-->"))
    last = job.lastProgress["batchId"]
    df = jobs.finish_assembly(spark, f"{path}/out", last, "host", "ingest_seq", "-->")
    return df.select("host", "ingest_seq", "n_lines", F.md5("message").alias("digest"))


@query(
    "stream_late_events",
    "SELECT strftime(ts - (event_id % 3) * INTERVAL '2 days', '%Y-%m-%d') AS event_day, count(*) AS n, count(*) FILTER (event_id % 3 > 0) AS late FROM events GROUP BY ALL",
)
def stream_late_events(spark, folder):
    """Events that arrive days late land in the partition of their own day."""
    events = table(spark, folder, "events").select(
        F.lit("syslog").alias("type"),
        F.expr("ts - make_dt_interval(cast(event_id % 3 * 2 as int))").alias("event_ts"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("ingest_seq"),
    )
    stream, path = _files(spark, folder, events, "late")
    _run(jobs.land_indexed(storage.route(stream).drop("index_name"), f"{path}/out", f"{path}/checkpoint"))
    out = EventStore(spark, f"{path}/out").scan()
    late = F.count_if(F.to_date("received_at") > F.col("event_date")).alias("late")
    return out.groupBy(F.col("event_date").cast("string").alias("event_day")).agg(F.count("*").alias("n"), late)


@query("stream_dashboard", CENTRAL_SQL)
def stream_dashboard(spark, folder):
    """The central dashboard from counts that the stream of raw lines keeps, folded on the way and at the end."""
    raw = L.syslog_lines(spark, folder).withColumn("received_at", F.date_trunc("second", "received_at"))
    stream, path = _files(spark, folder, raw, "dashboard")

    def parsed(lines):
        return syslog.parse_syslog(lines.withColumn("tags", tags_by_type(F.col("type"), F.col("tags"))))

    kept = PanelTables(spark, f"{path}/out", CENTRAL, fold_every=2)
    _run(kept.stream(stream, f"{path}/checkpoint", None, parsed))
    kept.fold()
    as_of = latest(table(spark, folder, "events"), "ts").replace(microsecond=0)
    return kept.panels(as_of, parsed(raw.filter(arrived_since(F.col("received_at"), as_of, CENTRAL.span))))


@query(
    "stream_alerts",
    "SELECT 'host' || cast(user_id % 10 as varchar) AS alert_host, 'LogstashAlertTest' AS alert_service, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY ALL",
)
def stream_alerts(spark, folder):
    stream, path = _files(spark, folder, L.canary_lines(spark, folder), "alerts")
    _run(jobs.alert_stream(stream, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").groupBy("alert_host", "alert_service").agg(F.count("*").alias("n"))


@query(
    "stream_maintained_store",
    f"""SELECT {_FAMILY_SQL} AS index_family, strftime(ts, '%Y-%m-%d') AS event_day, count(*) AS n, cast(sum(event_id) as bigint) AS ids,
    (SELECT max(cast(ts as date)) FROM events) - cast(ts as date) > 4 AS closed
    FROM events WHERE (SELECT max(cast(ts as date)) FROM events) - cast(ts as date) <= 8 GROUP BY ALL""",
)
def stream_maintained_store(spark, folder):
    """A store that is streamed into, maintained, streamed into by the same query again, and maintained again."""
    events = storage.route(typed_events(spark, folder)).drop("index_name")
    path = storage.shared_folder(spark, "maintained")
    store, today = EventStore(spark, f"{path}/out"), latest(events, "event_ts").date()
    for part in range(2):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        _run(jobs.land_indexed(stream, f"{path}/out", f"{path}/checkpoint"))
        store.maintain(today)
        store.fold()
    days = store.days().select("index_family", "event_date", "closed")
    rows = store.scan(closed=True).groupBy("index_family", "event_date").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return rows.join(days, ["index_family", "event_date"]).select("index_family", F.col("event_date").cast("string").alias("event_day"), "n", "ids", "closed")


@query(
    "stream_index_types",
    f"""WITH {_DOC_LINES} SELECT 'VMware' AS type, 'logstash' AS index_family, count(*) AS n, md5(string_agg(CAST(start AS VARCHAR), ',' ORDER BY start, doc_id)) AS digest
    FROM (SELECT DISTINCT doc_id, start FROM grouped)
    UNION ALL SELECT 'syslog', 'redhat', count(*), md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) FROM events
    UNION ALL SELECT 'redis', 'logstash', count(*), md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) FROM events""",
)
def stream_index_types(spark, folder):
    """The indexing job on a stream: parsed, assembled and unknown lines into one store."""
    names = ["type", "message", "host", "received_at", "ingest_seq", "tags"]
    documents = L.document_lines(spark, folder).withColumn("received_at", F.lit("2024-01-10").cast("timestamp")).withColumn("tags", no_tags())
    lines = L.syslog_lines(spark, folder).select(*names).unionByName(documents.select(*names))
    lines = lines.unionByName(L.raw_events(spark, folder, F.lit("as it came"), "redis").select(*names))
    with tidy(spark):
        stream, path = _files_in_order(spark, lines, "index")
        job = _run(jobs.index_stream(stream, f"{path}/out", f"{path}/checkpoint", types=["syslog", "redis"]))
        jobs.finish_index(spark, f"{path}/out", job.lastProgress["batchId"])
    events = EventStore(spark, f"{path}/out").scan()
    return events_digest(events, "type", "index_family")


#: Sequence numbers whose text is put together in one group.
CHUNK = 1 << 13


def events_digest(events, *keys):
    """n, and the MD5 of all sequence numbers in order, of each group.

    The text of a group is put together from that of its chunks, which are sorted apart; equal numbers are counted.
    """
    seq = F.col("ingest_seq")
    counts = events.groupBy(*keys, seq).agg(F.count("*").alias("n"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(seq.isNotNull(), F.struct(seq.alias("s"), "n")))), lambda x: F.array_join(F.array_repeat(x.s.cast("string"), x.n.cast("int")), ","))
    chunks = counts.groupBy(*keys, F.floor(seq / CHUNK).alias("chunk")).agg(F.sum("n").alias("n"), F.array_join(texts, ",").alias("text"))
    parts = F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("chunk", "text"))))
    return chunks.groupBy(*keys).agg(F.sum("n").alias("n"), F.md5(F.array_join(F.transform(parts, lambda x: x.text), ",")).alias("digest"))
