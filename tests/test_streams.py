"""Streams: restart from the checkpoint, carried-over events, late data."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from timberline.operators.multiline import assemble
from timberline.sources.channels import read_channel
from timberline.streaming.assembly import Assembly

from timberline.operators.panels import histogram
from timberline.session import prepare
from timberline.streaming import jobs


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_open_event_goes_on_after_a_restart(spark, tmp_path):
    prepare(spark)
    schema = "host string, seq bigint, message string"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        lines = spark.readStream.schema(schema).parquet(source)
        job = jobs.assemble_stream(lines, out, mark, "host", "seq", "^-->")
        job.awaitTermination()
        return job.lastProgress["batchId"]

    add(spark, source, [("a", 1, "one"), ("a", 2, "--> more"), ("b", 1, "--> lost start")], schema)
    run()
    add(spark, source, [("a", 3, "--> end"), ("a", 4, "two"), ("b", 2, "first")], schema)
    last = run()
    got = {(r.host, r.seq): r.message for r in jobs.finish_assembly(spark, out, last, "host", "seq", "^-->").collect()}
    assert got == {
        ("a", 1): "one\n--> more\n--> end",
        ("a", 4): "two",
        ("b", 1): "--> lost start",
        ("b", 2): "first",
    }


SCHEMA = "host string, seq bigint, message string, at timestamp"
AT = dt.datetime(2024, 1, 1)


def minute(host: str, seq: int, message: str, m: float) -> tuple:
    return host, seq, message, AT + dt.timedelta(minutes=m)


def live(spark, tmp_path, batches, wait="10 minutes"):
    """Run the batches one after the other, each in a query that starts anew; what has ended after each, and the job."""
    prepare(spark)
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    job, ended = Assembly(out, "host", "seq", "^-->", "at", wait), []
    for batch in batches:
        add(spark, source, batch, SCHEMA)
        query = job.start(spark.readStream.schema(SCHEMA).parquet(source), mark)
        query.awaitTermination()
        assert query.exception() is None
        ended.append({(r.host, r.seq): r.message for r in job.ended(spark).collect()})
    return ended, job, query.lastProgress["batchId"]


def test_quiet_source_ends_after_the_wait(spark, tmp_path):
    ended, _, _ = live(
        spark,
        tmp_path,
        [
            [minute("a", 1, "one", 0), minute("a", 2, "--> more", 1), minute("b", 1, "x", 0)],
            [minute("b", 2, "y", 8)],
            [minute("b", 3, "z", 12)],
            [minute("b", 4, "w", 30)],
        ],
    )
    assert ended[1] == {} and ended[2] == {("a", 1): "one\n--> more"} | {("b", 1): "x"}
    assert ended[3] == {("a", 1): "one\n--> more", ("b", 1): "x", ("b", 2): "y", ("b", 3): "z"}


def test_late_lines_join_inside_the_wait_and_not_after(spark, tmp_path):
    ended, job, last = live(
        spark,
        tmp_path,
        [
            [minute("a", 1, "one", 0), minute("a", 3, "two", 1)],
            [minute("a", 2, "--> late", 9)],
            [minute("a", 4, "--> of two", 15), minute("a", 6, "three", 40)],
            [minute("a", 5, "--> too late", 41)],
        ],
    )
    assert ended[2] == {("a", 1): "one\n--> late", ("a", 3): "two\n--> of two"}
    assert ended[3] == ended[2]
    whole = {(r.host, r.seq): r.message for r in job.finished(spark, last).collect()}
    assert whole == ended[2] | {("a", 5): "--> too late", ("a", 6): "three"}


def test_source_without_start_lines_is_carried_as_one_row(spark, tmp_path):
    batches = [[minute("a", 10 * i + j, f"--> {i} {j}", 5 * i) for j in range(10)] for i in range(5)]
    ended, job, last = live(spark, tmp_path, batches)
    assert ended[-1] == {}
    recent, state = (spark.read.parquet(f"{tmp_path}/out/{t}/batch={last}") for t in ("recent", "state"))
    assert recent.count() <= 30 and state.count() == 1
    settled = spark.read.parquet(f"{tmp_path}/out/settled")
    assert settled.count() + recent.count() == 50  # each line once
    whole = job.finished(spark, last).collect()
    assert [(r.seq, r.n_lines) for r in whole] == [(0, 50)]


@pytest.mark.parametrize("seed", range(1))
def test_live_assembly_equals_the_batch(spark, tmp_path, seed):
    """Lines that are late by less than the wait, over restarts, with a batch that is run again."""
    rng = random.Random(seed)
    lines = []
    for host in "abcd":
        for i in range(60):
            start = host != "d" and (rng.random() < 0.3)
            lines.append((minute(host, i, f"{host}{i}" if start else f"--> {i}", i), i + rng.uniform(0, 9)))
    lines.sort(key=lambda x: x[1])
    rows = [(h, s, m, AT + dt.timedelta(minutes=arrived)) for (h, s, m, _), arrived in lines]
    ended, job, last = live(spark, tmp_path, [rows[i : i + 60] for i in range(0, len(rows), 60)])
    before = {(r.host, r.seq): r.message for r in job.finished(spark, last).collect()}
    for name in (str(last), f".{last}.crc"):  # the driver died before it noted the batch
        os.remove(f"{tmp_path}/mark/commits/{name}")
    query = job.start(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "mark"))
    query.awaitTermination()
    got = {(r.host, r.seq): r.message for r in job.finished(spark, last).collect()}
    want = assemble(spark.createDataFrame(rows, SCHEMA), "host", "seq", "^-->").collect()
    assert got == before == {(r.host, r.seq): r.message for r in want} and len(ended[-1]) > 10
    assert not [n for n in os.listdir(tmp_path / "out" / "state") if n.startswith("batch=") and int(n[6:]) < last - 1]


def test_channel_stream_is_numbered_and_assembled(spark, tmp_path):
    prepare(spark)
    text = {f: [f"{f} {i}" if i % 7 == 0 else f"--> {f} {i}" for i in range(500)] for f in "ab"}
    os.makedirs(tmp_path / "logs")
    for f, rows in text.items():
        (tmp_path / "logs" / f).write_text("\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        stream = read_channel(spark, str(tmp_path / "logs"), "VMware", stream=True, maxFilesPerTrigger="1")
        job = Assembly(str(tmp_path / "out"), "source_file", "ingest_seq", "^-->")
        query = job.start(stream, str(tmp_path / "mark"))
        query.awaitTermination()
        got = sorted(r.message for r in job.finished(spark, query.lastProgress["batchId"]).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted("\n".join(rows[i : i + 7]) for rows in text.values() for i in range(0, 500, 7))


def test_live_histogram_updates_buckets_across_batches(spark, tmp_path):
    prepare(spark)
    schema = "series string, event_ts timestamp"
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    at = dt.datetime(2024, 1, 1, 0, 0)
    everything = []
    for step in range(3):
        rows = [("s", at + dt.timedelta(minutes=step * 3 + i)) for i in range(6)]
        everything += rows
        add(spark, source, rows, schema)
        events = spark.readStream.schema(schema).parquet(source)
        jobs.live_histogram(events, out, mark, interval=None).awaitTermination()
    batch = histogram(spark.createDataFrame(everything, schema), "5m")
    live = jobs.current_histogram(spark, out)
    columns = ["series", "bucket", "n"]
    assert sorted(map(tuple, live.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
