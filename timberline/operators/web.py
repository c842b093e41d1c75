"""Web server logs: combined access log and IIS W3C log."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import once, parse
from timberline.functions.grammar import block, line_pattern
from timberline.functions.scalar import http_time
from timberline.functions.tags import failed

# Apache's combined format: %h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-agent}i".
COMBINED = line_pattern(
    r"(?<!\S){clientip:token} {ident:token} {auth:token} \[{timestamp:httptime}\] "
    r"{_line:quoted} {response:nonnegint} (?:{bytes:nonnegint}|-) {referrer:quoted} {agent:quoted}"
)
# RFC 9112: method, target and version of a request line.
REQUEST = r"^([A-Za-z]+) (\S+)(?: HTTP/([0-9.]+))?$"

# W3C extended log: the fields of a line, parted by blanks; a hyphen stands for no value and is kept.
IIS_FIELDS = (
    "date time hostname cs_method cs_stem cs_query src_port cs_username clientip cs_useragent "
    "sc_status sc_subresponse sc_win32_status timetaken"
).split()
IIS_NUMBERS = ["src_port", "sc_status", "sc_subresponse", "sc_win32_status", "timetaken"]
# The field names the dashboards know.
IIS_NAMES = {
    "cs_method": "method",
    "cs_stem": "request",
    "cs_useragent": "agent",
    "cs_username": "username",
    "sc_status": "response",
    "timetaken": "time_request",
}


def parse_access_log(df: DataFrame) -> DataFrame:
    """Apache and nginx combined log lines; ``-`` bytes are NULL."""
    df = parse(df, COMBINED, longs=["response", "bytes"])
    line = F.expr("substr(_line, 2, length(_line) - 2)")
    method, request, version = (F.nullif(F.regexp_extract(line, REQUEST, i), F.lit("")) for i in (1, 2, 3))
    df = df.withColumns({"method": method, "request": request, "httpversion": version})
    df = df.withColumn("rawrequest", F.when(F.col("method").isNull(), F.nullif(line, F.lit("")))).drop("_line")
    return df.withColumns(
        {
            "event_ts": F.coalesce(http_time(F.col("timestamp")), "received_at"),
            "src_ip": F.col("clientip"),
            "source_host": F.col("host"),
            "msg": F.col("message"),
            "apache_vhost": F.when(F.col("message").contains(" "), F.substring_index("message", " ", 1)),
            "tags": failed(F.col("tags"), F.col("parsed")),
        }
    )


def parse_iis(df: DataFrame) -> DataFrame:
    """IIS lines; ``#`` header lines are dropped, lines without text are kept as failures."""
    df = df.filter(F.coalesce(~F.col("message").startswith("#"), F.lit(True)))
    df = once(df, "_parts", F.split("message", " "))
    fields = {n: F.expr(f"get(_parts, {i})") for i, n in enumerate(IIS_FIELDS)}
    whole = [F.size("_parts") == len(IIS_FIELDS), *(fields[n].rlike("^[0-9]+$") for n in IIS_NUMBERS)]
    logtime = F.concat_ws(" ", fields["date"], fields["time"])
    ok = F.coalesce(reduce(and_, whole) & logtime.rlike(f"^{block('isotime')}$"), F.lit(False))
    df = df.withColumn("parsed", ok).withColumn("logtime", F.when(ok, logtime))
    for name in IIS_FIELDS[2:]:
        value = fields[name].try_cast("bigint") if name in IIS_NUMBERS else fields[name]
        df = df.withColumn(name, F.when(ok, value))
    df = df.drop("_parts").withColumnsRenamed(IIS_NAMES)
    logtime = F.try_to_timestamp("logtime", F.lit("yyyy-MM-dd HH:mm:ss"))
    return df.withColumns(
        {
            "event_ts": F.coalesce(logtime, "received_at"),
            "src_ip": F.col("clientip"),
            "source_host": F.coalesce("hostname", "host"),
            "msg": F.col("message"),
            "tags": failed(F.col("tags"), F.col("parsed")),
        }
    )
