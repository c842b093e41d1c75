"""Field types of the event store, applied before writing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The numeric fields of the default family's template.
LONG_FIELDS = [
    "actconn", "backend_queue", "beconn", "bytes", "bytes_read",
    "datastore_latency_from", "datastore_latency_to", "feconn", "response_time",
    "retries", "srv_queue", "srvconn", "time_backend_connect", "time_backend_response",
    "time_duration", "time_queue", "time_request",
]
TEMPLATE = {name: "bigint" for name in LONG_FIELDS} | {"event_ts": "timestamp"}

# Fields dropped per source type once they have been used.
PRUNED = {
    "apache": ["clientip", "host", "timestamp"],
    "nginx": ["clientip", "host", "timestamp"],
    "eventlog": ["SourceModuleType", "EventTimeWritten", "EventReceivedTime", "EventType"],
    "iis": ["clientip", "host", "hostname", "logtime"],
    "syslog": ["host", "received_at", "received_from", "syslog_hostname", "syslog_message", "syslog_timestamp"],
    "VMware": ["host", "program", "syslog_hostname", "syslog_message", "syslog_timestamp"],
    "vCenter": ["host", "message-body", "program", "syslog_hostname", "syslog_message", "syslog_timestamp"],
}


def apply_template(df: DataFrame, template: Mapping[str, str] = TEMPLATE) -> DataFrame:
    """Cast the template's fields; a bad value is NULL and named in ``parse_errors``."""
    typed = {n: F.col(n).try_cast(t) for n, t in template.items() if n in df.columns}
    bad = [F.when(F.col(n).isNotNull() & c.isNull(), F.lit(n)) for n, c in typed.items()]
    errors = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.withColumn("parse_errors", errors).withColumns(typed)


def prune(df: DataFrame, source_type: str) -> DataFrame:
    """Drop the type's used-up fields from a table of that type."""
    return df.drop(*PRUNED.get(source_type, []))


def prune_mixed(df: DataFrame) -> DataFrame:
    """The same on a table of all types: the fields become NULL."""
    out = {}
    for name in df.columns:
        types = [t for t, names in PRUNED.items() if name in names]
        if types:
            out[name] = F.when(~F.coalesce(F.col("type").isin(*types), F.lit(False)), F.col(name))
    return df.withColumns(out)
