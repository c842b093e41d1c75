"""Heavy work is dealt out by rows, whatever row groups a file has."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from timberline import session


def test_one_row_group_in_many_read_tasks(spark, tmp_path, monkeypatch):
    """A file of one row group that is cut into as many read tasks as there are cores: one of them has all rows."""
    monkeypatch.setattr(session, "TASK_ROWS", 250, raising=False)
    n = 20_000
    pq.write_table(pa.table({"event_id": range(n), "x": [f"value {i * 7919 % n}" for i in range(n)]}), tmp_path / "events.parquet", row_group_size=n)
    cores = spark.sparkContext.defaultParallelism
    size = (tmp_path / "events.parquet").stat().st_size
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // (cores + 1)))
        df = session.table(spark, str(tmp_path), "events")
        assert cores <= df.rdd.getNumPartitions() < n // 250
        out = session.spread(df)
        rows = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(rows) == n
    assert max(rows) <= 2 * 250
    assert out.agg(F.sum("event_id")).first()[0] == n * (n - 1) // 2


def test_small_tables_use_all_cores(spark):
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
