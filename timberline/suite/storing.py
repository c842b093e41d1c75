"""Channels, routing, the partitioned store and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from timberline.session import latest, table
from timberline.sources import channels, storage
from timberline.suite import query

KINDS = ["syslog", "firewall", "VMware", "vCenter", "eventlog", "iis"]
_KIND_SQL = "(['syslog', 'firewall', 'VMware', 'vCenter', 'eventlog', 'iis'])[event_id % 6 + 1]"
_FAMILY_SQL = "(CASE WHEN event_id % 6 = 0 THEN 'redhat' ELSE 'logstash' END)"


def typed_events(spark, folder):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return table(spark, folder, "events").select(
        "event_id", F.get(kinds, (F.col("event_id") % 6).cast("int")).alias("type"), F.col("ts").alias("event_ts"), "value"
    )


@query("route_index_family", f"SELECT event_id, {_KIND_SQL} AS type, {_FAMILY_SQL} AS index_family FROM events")
def route_index_family(spark, folder):
    return storage.route(typed_events(spark, folder)).select("event_id", "type", "index_family")


@query("daily_index_counts", f"SELECT {_FAMILY_SQL} || '-' || strftime(ts, '%Y.%m.%d') AS index_name, count(*) AS n FROM events GROUP BY ALL")
def daily_index_counts(spark, folder):
    return storage.route(typed_events(spark, folder)).groupBy("index_name").agg(F.count("*").alias("n"))


@query("ingest_channels", f"SELECT {_KIND_SQL} AS type, count(*) AS n, cast(sum(length('event ' || cast(event_id as varchar))) as bigint) AS chars FROM events GROUP BY ALL")
def ingest_channels(spark, folder):
    """Lines are written as text files per channel and read back as typed channels."""
    path = storage.shared_folder(spark, "channels")
    lines = typed_events(spark, folder).select("type", F.expr("'event ' || cast(event_id as string)").alias("value"))
    lines.write.partitionBy("type").text(path)
    df = channels.read_channels(spark, {kind: f"{path}/type={kind}" for kind in KINDS})
    return df.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("message")).alias("chars"))


@query(
    "pruned_scan",
    f"""SELECT event_id, {_KIND_SQL} AS type, value FROM events, (SELECT max(ts) AS m FROM events) WHERE ts BETWEEN m - INTERVAL '3 days' AND m AND event_id % 6 <> 0""",
)
def pruned_scan(spark, folder):
    """The store is written once per call; the read opens four day folders of one family."""
    path = storage.shared_folder(spark, "store")
    events = storage.route(typed_events(spark, folder))
    storage.write_events(events, path)
    as_of = latest(events, "event_ts")
    df = storage.scan_events(spark, path, as_of - dt.timedelta(days=3), as_of, ["logstash"])
    return df.select("event_id", "type", "value")


def _retention_sql(policy: str) -> str:
    return f"""WITH p AS (SELECT {_FAMILY_SQL} AS index_family, cast(ts as date) AS d, count(*) AS n FROM events GROUP BY ALL),
    r(f, o, c, x) AS (VALUES {policy}), a AS (SELECT p.*, cast((SELECT max(cast(ts as date)) FROM events) - d as bigint) AS age_days, o, c, x FROM p LEFT JOIN r ON f = index_family)
    SELECT index_family, strftime(d, '%Y-%m-%d') AS event_day, n, age_days,
    CASE WHEN age_days > x THEN 'delete' WHEN age_days > c THEN 'close' WHEN age_days > o THEN 'optimize' ELSE 'keep' END AS action, coalesce(age_days > c, false) AS closed FROM a"""


def _plan(spark, folder, policies):
    events = storage.route(typed_events(spark, folder))
    as_of = F.lit(latest(events, "event_ts").date())
    plan = storage.retention_plan(storage.daily_partitions(events), storage.policy_table(spark, policies), as_of)
    return plan.select("index_family", F.col("event_date").cast("string").alias("event_day"), "n", "age_days", "action", "closed")


@query("retention_plan", _retention_sql("('redhat', 2, 4, 8), ('logstash', 2, 4, 8)"))
def retention_plan(spark, folder):
    return _plan(spark, folder, storage.POLICIES)


@query("retention_by_policy", _retention_sql("('redhat', 2, 7, 60), ('logstash', 2, 4, 8)"))
def retention_by_policy(spark, folder):
    return _plan(spark, folder, {**storage.POLICIES, "redhat": storage.POLICIES[".marvel"]})


@query(
    "retention_apply",
    f"SELECT {_FAMILY_SQL} AS index_family, strftime(ts, '%Y-%m-%d') AS event_day, count(*) AS n FROM events WHERE (SELECT max(cast(ts as date)) FROM events) - cast(ts as date) <= 8 GROUP BY ALL",
)
def retention_apply(spark, folder):
    """Partitions older than the policy are deleted; the rest is read back."""
    path = storage.shared_folder(spark, "store")
    events = storage.route(typed_events(spark, folder))
    storage.write_events(events, path)
    as_of = F.lit(latest(events, "event_ts").date())
    plan = storage.retention_plan(storage.daily_partitions(events), storage.policy_table(spark), as_of)
    storage.apply_retention(spark, path, plan)
    left = spark.read.parquet(path)
    return left.groupBy("index_family", F.col("event_date").cast("string").alias("event_day")).agg(F.count("*").alias("n"))


@query(
    "compaction",
    f"SELECT {_FAMILY_SQL} AS index_family, strftime(ts, '%Y-%m-%d') AS event_day, count(*) AS n, cast(sum(event_id) as bigint) AS ids FROM events GROUP BY ALL",
)
def compaction(spark, folder):
    """The partitions due for merging are rewritten; every event is still there."""
    path = storage.shared_folder(spark, "store")
    events = storage.route(typed_events(spark, folder))
    storage.write_events(events, path)
    as_of = F.lit(latest(events, "event_ts").date())
    plan = storage.retention_plan(storage.daily_partitions(events), storage.policy_table(spark), as_of)
    for row in plan.filter(F.col("action") == "optimize").collect():  # one row per day and family
        storage.compact(spark, path, row.index_family, row.event_date)
    df = spark.read.parquet(path)
    return df.groupBy("index_family", F.col("event_date").cast("string").alias("event_day")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids")
    )
