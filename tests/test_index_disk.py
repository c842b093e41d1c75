"""What the indexing stream leaves on disk and in memory on its way."""

from __future__ import annotations

import datetime as dt
import glob

import pyarrow.parquet as pq

from timberline.session import prepare, tidy
from timberline.sources.store import EventStore
from timberline.streaming import jobs
from timberline.suite import streams

SCHEMA = "type string, message string, host string, received_at timestamp, ingest_seq long, tags array<string>"


def lines(n: int) -> list[tuple]:
    at, out = dt.datetime(2024, 1, 10), []
    for i in range(n):
        out.append(("syslog", f"<13>Jan 10 00:00:{i % 60:02d} host1 sshd[{i}]: session opened for user{i}", "relay", at, i, []))
        out.append(("redis", "as it came", "relay", at, i, []))
        out.append(("VMware", "--> goes on" if i % 3 else f"start {i}", "doc1", at, i, []))
    return out


def test_index_stream_releases_its_batches(spark, tmp_path):
    """Lines of a batch are not kept, and assembled events not stored twice, once the event store has them."""
    prepare(spark)
    path, rows = str(tmp_path), lines(40)
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[4] // 10 == part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with tidy(spark):
        job = jobs.index_stream(raw, f"{path}/out", f"{path}/mark", types=["syslog", "redis"])
        job.awaitTermination()
        jobs.finish_index(spark, f"{path}/out", job.lastProgress["batchId"])
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= kept
    assert not glob.glob(f"{path}/out/lines/*/events/batch=*")
    files = glob.glob(f"{path}/out/data/**/*.parquet", recursive=True)
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
    got = EventStore(spark, f"{path}/out").scan().groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in got} == {"syslog": 40, "redis": 40, "VMware": 14}


def test_more_lines_come_in_more_batches(spark, monkeypatch, tmp_path):
    """A batch of lines in order stays as large as it is, and its files go when it was read."""
    prepare(spark)
    monkeypatch.setattr(streams, "LINES", 30)
    monkeypatch.setattr(streams.storage, "shared_folder", lambda spark, name: f"{tmp_path}/{name}")
    stream, path = streams._files_in_order(spark, spark.createDataFrame(lines(100), SCHEMA).repartition(3), "lines")
    written, seen = glob.glob(f"{path}/in/*.parquet"), []
    put = lambda batch, number: seen.append(sorted(r["ingest_seq"] for r in batch.collect()))
    stream.writeStream.option("checkpointLocation", f"{path}/mark").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    assert seen == [sorted(i for i in range(a, a + 10) for _ in range(3)) for a in range(0, 100, 10)]
    assert len(glob.glob(f"{path}/in/*.parquet")) < len(written) == 10


def test_tidy_gives_the_setting_back(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with tidy(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before
