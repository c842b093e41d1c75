"""Session settings the library relies on, and table access."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that decide results, runtime re-planning, and a limit
# that keeps generated methods small enough for the JVM to compile (it leaves
# methods over 8000 bytes to its interpreter, which halves the speed of wide parsers).
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}
#: Rows of one task of work that is heavy per row.
TASK_ROWS = 1 << 17


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs, and streams that are started meanwhile, remove the files of their shuffles when each is done.

    Else these stay until the driver happens to collect its garbage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; timestamps without zone are read as UTC, which event time needs.

    The reader does that, not a cast, so that time filters reach the files.
    """
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out for work that is heavy per row: to all cores, and no more than ``TASK_ROWS`` a task.

    A row group is read by one task, whatever number of rows it has, so a file that is cut into many read
    tasks may still have all rows in a few of them.  The rows are counted from the files' footers; tables
    with at least as many read tasks as that takes are left as they are, without a shuffle.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def latest(df: DataFrame, column: str) -> dt.datetime:
    """The newest time of a column, as one value for the driver.

    It reads that column only.  A live dashboard passes the current time instead.
    """
    text = df.agg(F.date_format(F.max(column), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first()["t"]
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f").replace(tzinfo=dt.timezone.utc)
