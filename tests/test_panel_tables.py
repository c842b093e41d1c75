"""Kept panel tables: equal to the panels of all events for any range, over late rows, restarts and folds."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from timberline.functions.search import NamedQuery, equals, everything
from timberline.plans.dashboards import Dashboard
from timberline.session import prepare
from timberline.streaming.panel_tables import PanelTables

AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_ts timestamp, host string, program string"
BOARD = Dashboard(
    span="12h",
    queries=lambda: [
        NamedQuery("all", everything()),
        NamedQuery("cron", equals(F.col("program"), "cron")),
        NamedQuery("off", everything(), enabled=False),
    ],
    must=lambda: F.col("program").isNotNull(),
    histogram=["all", "cron"],
    terms={"Hosts": ("host", 3, ["all"]), "Programs of cron": ("program", 2, ["cron"])},
    fields=["event_ts", "host"],
    trim={},
)


def rows(panels):
    return sorted(map(str, (tuple(r) for r in panels.select("panel", "series", "key", "n").collect())))


def events_of(rng, n, hours):
    made = []
    for _ in range(n):
        at = AT + dt.timedelta(hours=rng.uniform(0, hours)) if rng.random() < 0.9 else AT + dt.timedelta(minutes=5 * rng.randrange(int(hours * 12)))
        made.append((at if rng.random() < 0.98 else None, rng.choice([None, *"abcdef"]), rng.choice([None, "cron", "sshd"])))
    return made


def run(spark, kept, folder, mark, batch):
    if batch:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    query = kept.stream(spark.readStream.schema(SCHEMA).parquet(folder), mark, None)
    query.awaitTermination()
    return query


def test_equal_to_the_panels_of_all_events(spark, tmp_path):
    prepare(spark)
    rng = random.Random(5)
    folder, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    kept = PanelTables(spark, str(tmp_path / "out"), BOARD, fold_every=3)
    batches = [events_of(rng, 150, 30) for _ in range(5)]  # each with rows of the whole time: late ones too
    for batch in batches:
        last = run(spark, kept, folder, mark, batch)
    number = last.lastProgress["batchId"]
    everything_seen = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    times = [AT + dt.timedelta(hours=h) for h in (13, 29.37)] + [AT + dt.timedelta(hours=20, microseconds=-1)]
    want = [rows(BOARD.panels(everything_seen, t)) for t in times]
    assert [rows(kept.panels(t, everything_seen)) for t in times] == want
    for name in (str(number), f".{number}.crc"):  # the driver died before it noted the batch
        os.remove(f"{mark}/commits/{name}")
    run(spark, kept, folder, mark, [])
    kept.fold()
    assert [rows(kept.panels(t, everything_seen)) for t in times] == want
    assert {len(kept.store.live().of(k)) for k in kept.store.live().days()} == {1}
    day = kept.store.scan().groupBy("panel", "series", "key", "bucket").count()
    assert day.where("count > 1").count() == 0  # one row a cell and bucket
    kept.add(spark.createDataFrame([(AT + dt.timedelta(hours=12), "new", "cron")] * 100, SCHEMA))
    assert ("('Hosts', None, 'new', 100)") in rows(kept.panels(AT + dt.timedelta(hours=13)))


def test_folders_do_not_grow_with_triggers(spark, tmp_path):
    prepare(spark)
    kept = PanelTables(spark, str(tmp_path / "out"), BOARD, fold_every=3)
    for i in range(8):
        run(spark, kept, str(tmp_path / "in"), str(tmp_path / "mark"), [(AT + dt.timedelta(minutes=i), "a", "cron")])
        assert len(kept.store.live().folders) <= 4
    assert "('hits', 'cron', None, 8)" in rows(kept.panels(AT + dt.timedelta(hours=1)))


def test_no_events_and_empty_buckets(spark, tmp_path):
    """Every bucket of the range is there, with 0 where nothing happened; no hits are no row."""
    prepare(spark)
    kept = PanelTables(spark, str(tmp_path / "out"), BOARD)
    kept.add(spark.createDataFrame([], SCHEMA))
    got = rows(kept.panels(AT + dt.timedelta(hours=12)))
    assert got == rows(BOARD.panels(spark.createDataFrame([], SCHEMA), AT + dt.timedelta(hours=12)))
    assert len(got) == 2 * 145 and all(r.endswith(", 0)") for r in got)


def test_width_that_does_not_fit(spark, tmp_path):
    with pytest.raises(ValueError, match="do not make up"):
        PanelTables(spark, str(tmp_path), BOARD, width="10m")
