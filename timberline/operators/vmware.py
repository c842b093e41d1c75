"""ESXi and vCenter lines, and the storage health messages in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import clean, fields_of, layout_of, parse, rewrite
from timberline.functions.grammar import line_pattern
from timberline.functions.scalar import decode_pri, iso_time
from timberline.functions.tags import failed

_INFO = r"\[{message_thread_id:data} {syslog_level:data} '{message_service:data}' ?{message_opID:data}\]"
_BODIES = [
    _INFO + r" \[{message_service_info:data}\] {syslog_message:all}",
    _INFO + r" {syslog_message:all}",
    r"{syslog_message:all}",
]
_ESXI = (
    r"<{syslog_pri:pri}>{syslog_timestamp:isotime} {syslog_hostname:iporhost} "
    r"{program:prog}(?:\[{pid:posint}\])?: "
)
_VCENTER = r"<{syslog_pri:pri}>{:syslogtime} {syslog_hostname:iporhost} {syslog_timestamp:isotime} "
ESXI = [line_pattern(_ESXI + body) for body in _BODIES]
VCENTER = [line_pattern(_VCENTER + body) for body in _BODIES]

LATENCY = line_pattern(
    r"Device naa\.{device_naa:word} performance has {device_status:word}.* (?:of|from) "
    r"{datastore_latency_from:int}.* to {datastore_latency_to:int}"
)
VOLUME = line_pattern(
    r"Hostd: .* : {device_access:data} to volume {device_id:data} {datastore:data} (?:following|due to)"
)
WARNING = line_pattern(r"WARNING: {vmware_warning_msg:rest}")


def _header(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            **decode_pri(F.col("syslog_pri")),
            "event_ts": F.coalesce(iso_time(F.col("syslog_timestamp")), "received_at"),
            "source_host": F.coalesce("syslog_hostname", "host"),
            "msg": F.coalesce("syslog_message", "message"),
            "tags": failed(F.col("tags"), F.col("parsed")),
        }
    )


def parse_esxi(df: DataFrame) -> DataFrame:
    return _header(parse(df, ESXI, longs=["syslog_pri", "pid"]))


def parse_vcenter(df: DataFrame) -> DataFrame:
    return _header(parse(df, VCENTER, longs=["syslog_pri"]))


def parse_storage_health(df: DataFrame) -> DataFrame:
    """Latency, lost access and warnings; each regex runs only on lines with its words."""
    message = F.col("message")
    for words, pattern, ok, longs in [
        ("Device naa", LATENCY, "_latency", ["datastore_latency_from", "datastore_latency_to"]),
        ("connectivity issues", VOLUME, "_volume", []),
        ("WARNING", WARNING, "_warning", []),
    ]:
        layout = layout_of([pattern])
        rewritten = F.when(message.contains(words), rewrite(clean(message), [pattern]))
        df = fields_of(df, rewritten, layout, ok, longs=longs).drop(ok)
    return df
