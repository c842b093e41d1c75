"""The event store: routing, daily partitions, pruned reads, retention."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["index_family", "event_date"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, the folder that the driver and all executors share.

    Only where that is unset, as in tests, a folder of this machine is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def index_family(source_type: Column) -> Column:
    """Family per source type, so that each family has its own retention."""
    return F.when(source_type == "syslog", F.lit("redhat")).otherwise(F.lit("logstash"))


def route(df: DataFrame, ts: str = "event_ts") -> DataFrame:
    """Add the family, the UTC event day and the daily index name."""
    day = F.to_date(ts)
    return df.withColumns({"index_family": index_family(F.col("type")), "event_date": day}).withColumn(
        "index_name", F.concat("index_family", F.lit("-"), F.date_format("event_date", "yyyy.MM.dd"))
    )


def write_events(df: DataFrame, path: str, mode: str = "append", records_per_file: int = 5_000_000) -> None:
    """Write routed events, one folder per family and day.

    The rebalance hint lets adaptive execution split a busy day over many tasks
    and merge quiet ones, so file sizes stay even.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in PARTITIONS])
        .write.partitionBy(*PARTITIONS)
        .option("maxRecordsPerFile", records_per_file)
        .mode(mode)
        .parquet(path)
    )


# Index family -> days after which partitions are merged, closed, deleted.
POLICIES = {
    "redhat": (2, 4, 8),
    "logstash": (2, 4, 8),
    ".marvel": (2, 7, 60),
}


def scan_events(
    spark: SparkSession,
    path: str,
    start: dt.datetime,
    end: dt.datetime,
    families: Sequence[str] | None = None,
    ts: str = "event_ts",
    today: dt.date | None = None,
    policies: dict[str, tuple[int, int, int]] | None = None,
) -> DataFrame:
    """Read only the day folders (and families) that cover a time range.

    With ``today``, the days that the policy of their family has closed are left out, also
    by their folders; without it, all days that are there are read.
    """
    df = spark.read.parquet(path)
    days = F.col("event_date").between(F.lit(start.date()), F.lit(end.date()))
    if families:
        days = days & F.col("index_family").isin(*families)
    if today is not None:
        for family, (_, close, _) in (policies or POLICIES).items():
            open_since = F.col("event_date") >= F.lit(today - dt.timedelta(days=close))
            days = days & ((F.col("index_family") != family) | open_since)
    return df.filter(days & F.col(ts).between(F.lit(start), F.lit(end)))


def policy_table(spark: SparkSession, policies: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    names = ["index_family", "optimize_days", "close_days", "delete_days"]
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (family, *days))])
        for family, days in (policies or POLICIES).items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def daily_partitions(df: DataFrame) -> DataFrame:
    """The partitions of routed events, with their sizes."""
    return df.groupBy(*PARTITIONS).agg(F.count("*").alias("n"))


def retention_plan(partitions: DataFrame, policy: DataFrame, as_of: Column) -> DataFrame:
    """What the daily job does with each partition: delete, close, optimize or keep."""
    age = F.datediff(as_of, "event_date")
    return partitions.join(policy, "index_family", "left").select(
        "index_family",
        "event_date",
        "n",
        age.cast("bigint").alias("age_days"),
        F.when(age > F.col("delete_days"), "delete")
        .when(age > F.col("close_days"), "close")
        .when(age > F.col("optimize_days"), "optimize")
        .otherwise("keep")
        .alias("action"),
        F.coalesce(age > F.col("close_days"), F.lit(False)).alias("closed"),
    )


def _fs_path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _batch_store(spark: SparkSession, path: str) -> None:
    fs, log = _fs_path(spark, f"{path}/_spark_metadata")
    if fs.exists(log):
        raise ValueError(f"{path} is written by Spark's file stream, whose log names its files; use sources.store.EventStore")


def apply_retention(spark: SparkSession, path: str, plan: DataFrame) -> list[str]:
    """Drop the folders of partitions planned for deletion; returns them.  For stores that one batch job writes."""
    _batch_store(spark, path)
    gone = []
    for row in plan.filter(F.col("action") == "delete").select(*PARTITIONS).collect():  # one row per day
        folder = f"{path}/index_family={row.index_family}/event_date={row.event_date}"
        fs, target = _fs_path(spark, folder)
        if fs.exists(target):
            fs.delete(target, True)
            gone.append(folder)
    return gone


def compact(spark: SparkSession, path: str, family: str, day: dt.date, file_bytes: int = 256 << 20) -> int:
    """Merge one partition's files into files of about ``file_bytes``.

    The new files are written next to the store and swapped in by rename; the old
    folder is only removed after that.  A job that dies between the two renames leaves
    the old folder as ``_aside-*``, to be renamed back.  Returns the number of files written.

    For stores that one batch job writes.  ``sources.store.EventStore`` can be written, merged and read at once.
    """
    _batch_store(spark, path)
    folder = f"{path}/index_family={family}/event_date={day}"
    fs, old = _fs_path(spark, folder)
    size = fs.getContentSummary(old).getLength()
    files = max(1, -(-size // file_bytes))
    stamp = uuid.uuid4().hex
    fresh, aside = f"{path}/_fresh-{stamp}", f"{path}/_aside-{stamp}"
    events = spark.read.parquet(folder)
    events.repartition(files).write.parquet(fresh)
    fs.rename(old, _fs_path(spark, aside)[1])
    fs.rename(_fs_path(spark, fresh)[1], old)
    fs.delete(_fs_path(spark, aside)[1], True)
    return files
