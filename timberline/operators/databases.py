"""Database server logs: MySQL slow queries, Redis, PostgreSQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import parse
from timberline.functions.grammar import line_pattern
from timberline.functions.scalar import compact_time
from timberline.operators.multiline import assemble, split_lines

REDIS = line_pattern(r"\[{pid:posint}\] {timestamp:redistime} \*")
POSTGRES = line_pattern(r"{timestamp:datestamp} {:zone} {user_id:data} {connection_id:rest} {pid:posint}")
MYSQL_TIME = line_pattern(r"{date:num} *{time:notspace}", at_start=True)


#: Lines that go on with the entry before them.
MYSQL_CONTINUATION = r"^\s"


def parse_mysql_slow(df: DataFrame, source: str = "host", seq: str = "ingest_seq") -> DataFrame:
    """Slow-query entries: blank-led lines join the entry before them, the entry
    gives the time, and each of its lines becomes an event again."""
    return parse_mysql_entries(assemble(df, source, seq, MYSQL_CONTINUATION))


def parse_mysql_entries(entries: DataFrame) -> DataFrame:
    """The same for entries that are assembled."""
    entries = parse(entries, MYSQL_TIME, ok="parsed")
    entries = entries.withColumn("event_ts", compact_time(F.concat_ws(" ", "date", "time"))).drop("date", "time")
    return split_lines(entries)


def parse_redis(df: DataFrame) -> DataFrame:
    return parse(df, REDIS, longs=["pid"])


def parse_postgres(df: DataFrame) -> DataFrame:
    return parse(df, POSTGRES, longs=["pid"])
