"""The partitioned store: pruning, retention, compaction."""

from __future__ import annotations

import datetime as dt
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from timberline.operators.multiline import assemble
from timberline.session import prepare
from timberline.sources import storage
from timberline.sources.channels import read_channel, read_channels
from timberline.sources.template import apply_template

DAY = dt.date(2024, 1, 20)


@pytest.fixture()
def store(spark, tmp_path):
    prepare(spark)
    df = spark.range(4000).select(
        F.when(F.col("id") % 5 == 0, "syslog").otherwise("iis").alias("type"),
        "id",
        F.expr("timestamp'2024-01-20 12:00:00' - make_dt_interval(cast(id % 12 as int))").alias("event_ts"),
    )
    path = str(tmp_path / "store")
    for _ in range(2):
        storage.write_events(storage.route(df.repartition(5)), path, records_per_file=50)
    return path


def files(path, family, day):
    folder = f"{path}/index_family={family}/event_date={day}"
    return [f for f in os.listdir(folder) if f.endswith(".parquet")]


def test_scan_opens_only_the_days_of_the_range(spark, store):
    df = storage.scan_events(spark, store, dt.datetime(2024, 1, 18), dt.datetime(2024, 1, 19, 23), ["redhat"])
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text and "index_family" in text.split("PartitionFilters")[1]
    assert df.count() == sum(1 for i in range(4000) if i % 5 == 0 and i % 12 in (1, 2)) * 2


def test_closed_days_are_not_read(spark, store):
    whole = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))
    df = storage.scan_events(spark, store, *whole, today=DAY)
    plan = storage.retention_plan(storage.daily_partitions(spark.read.parquet(store)), storage.policy_table(spark), F.lit(DAY))
    still = {(r.index_family, r.event_date) for r in plan.filter("not closed").collect()}
    assert {(r.index_family, r.event_date) for r in df.select(*storage.PARTITIONS).distinct().collect()} == still
    assert "event_date" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert storage.scan_events(spark, store, *whole).count() == 8000


def test_retention_deletes_only_old_days(spark, store):
    parts = storage.daily_partitions(spark.read.parquet(store))
    plan = storage.retention_plan(parts, storage.policy_table(spark), F.lit(DAY))
    actions = {r.age_days: (r.action, r.closed) for r in plan.filter("index_family = 'logstash'").collect()}
    assert actions[11][0] == "delete" and actions[9][0] == "delete" and actions[8] == ("close", True)
    assert actions[5] == ("close", True) and actions[4] == ("optimize", False) and actions[2] == ("keep", False)
    gone = storage.apply_retention(spark, store, plan)
    assert len(gone) == 6  # three days of two families
    left = spark.read.parquet(store).agg(F.min("event_date")).first()[0]
    assert left == DAY - dt.timedelta(days=8)


def test_compaction_merges_files_and_keeps_rows(spark, store):
    day = DAY - dt.timedelta(days=3)
    before = spark.read.parquet(store).groupBy("event_date").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()
    assert len(files(store, "logstash", day)) > 1
    assert storage.compact(spark, store, "logstash", day) == 1
    assert len(files(store, "logstash", day)) == 1
    after = spark.read.parquet(store).groupBy("event_date").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()
    assert sorted(before) == sorted(after)


def test_shared_folder_comes_from_the_session():
    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default: conf.get(k, default), set=conf.__setitem__), made=conf)

    named = session(**{"spark.checkpoint.dir": "/shared/place/"})
    assert storage.shared_folder(named, "x").startswith("/shared/place/x-")
    unset = session()
    first = storage.shared_folder(unset, "x")
    assert first.startswith(unset.made["spark.checkpoint.dir"])


def test_channels_are_typed(spark, tmp_path):
    for name in ("syslog", "iis"):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "a.log").write_text(f"{name} one\n{name} two\n")
    df = read_channels(spark, {n: str(tmp_path / n) for n in ("syslog", "iis")})
    assert sorted((r.type, r.message, r.tags) for r in df.collect())[0] == ("iis", "iis one", [])


def test_lines_of_files_are_assembled_in_their_order(spark, tmp_path):
    """Files to events, with splits far smaller than the files."""
    text = {f: [f"{f} {i}" if i % 7 == 0 else f"--> {f} {i}" for i in range(3000)] for f in "abc"}
    os.makedirs(tmp_path / "logs")
    for f, rows in text.items():
        (tmp_path / "logs" / f).write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = read_channel(spark, str(tmp_path / "logs"), "VMware")
        assert raw.rdd.getNumPartitions() > 10
        events = assemble(raw, "source_file", "ingest_seq", "^-->").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted(e.message for e in events)
    assert got == sorted("\n".join(rows[i : i + 7]) for rows in text.values() for i in range(0, 3000, 7))
    assert {e.type for e in events} == {"VMware"}


def test_template_reports_bad_values(spark):
    df = spark.createDataFrame([("1", "x", None)], "bytes string, retries string, feconn string")
    row = apply_template(df).first()
    assert (row.bytes, row.retries, row.feconn, row.parse_errors) == (1, None, None, ["retries"])


def test_lockout_table_reads_the_written_store(spark, tmp_path):
    """The dashboards' event tables find their fields in events that were pruned and stored."""
    from timberline.fixtures import lines as L
    from timberline.plans.dashboards import LOCKOUTS, WINDOWS
    from timberline.plans.indexing import index_events

    raw = L.eventlog_lines(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "events")
    storage.write_events(index_events({"eventlog": raw}), path)
    kept = prepare(spark).read.parquet(path)
    assert kept.count() == raw.count()
    as_of = kept.agg(F.max("event_ts")).first()[0]
    for board in (LOCKOUTS, WINDOWS):
        rows = board.table(kept, as_of)
        assert set(board.fields) <= set(rows.columns) and rows.count() > 0
