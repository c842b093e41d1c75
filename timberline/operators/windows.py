"""Windows event records: JSON payloads into the shared event columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.tags import failed
from timberline.sources.channels import decode_json

# The keys of the collector's JSON record and their types.
EVENT_SCHEMA = (
    "EventType string, FileName string, Hostname string, Severity string, SeverityValue bigint, "
    "EventReceivedTime bigint, Message string, Channel string, SourceName string, SourceModuleName string, "
    "SourceModuleType string, Category string, EventID bigint, RecordNumber bigint, ProcessID bigint, "
    "EventTime string, EventTimeWritten string, UserID string, errorCode string, SubjectUserName string, "
    "TargetUserName string, flat_message string"
)
# Record key -> column.
EVENT_NAMES = {
    "Hostname": "source_host",
    "Message": "msg",
    "Severity": "eventlog_severity",
    "SeverityValue": "eventlog_severity_code",
    "Channel": "eventlog_channel",
    "SourceName": "eventlog_program",
    "SourceModuleName": "nxlog_input",
    "Category": "eventlog_category",
    "RecordNumber": "eventlog_record_number",
    "ProcessID": "eventlog_pid",
}
LOWERED = ["EventType", "FileName", "Hostname", "Severity"]


def normalize_eventlog(df: DataFrame) -> DataFrame:
    """Decode, lower-case, rename and time-stamp Windows events.

    ``EventID`` stays next to ``eventlog_id``: the lockout dashboard asks for the
    original name, the other panels for the new one.
    """
    df = decode_json(df, EVENT_SCHEMA)
    df = df.withColumns({c: F.lower(c) for c in LOWERED}).withColumnsRenamed(EVENT_NAMES)
    return df.withColumns(
        {
            "eventlog_id": F.col("EventID"),
            "event_ts": F.coalesce(F.timestamp_seconds("EventReceivedTime"), "received_at"),
            "tags": failed(F.col("tags"), F.col("json_ok")),
        }
    )
