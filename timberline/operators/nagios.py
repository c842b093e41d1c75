"""Nagios log lines: 16 record types and the external commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import lookup, parse, typed
from timberline.functions.grammar import line_pattern, register_pattern
from timberline.functions.tags import failed

# Record type -> its fields, separated by ``;`` in the line.
# The last field of a record takes the rest of the line.
RECORDS = {
    "CURRENT SERVICE STATE": "hostname service state statetype statecode message",
    "CURRENT HOST STATE": "hostname state statetype statecode message",
    "SERVICE NOTIFICATION": "notifyname hostname service state contact message",
    "HOST NOTIFICATION": "notifyname hostname state contact message",
    "SERVICE ALERT": "hostname service state statelevel attempt message",
    "HOST ALERT": "hostname state statelevel attempt message",
    "SERVICE FLAPPING ALERT": "hostname service state message",
    "HOST FLAPPING ALERT": "hostname state message",
    "SERVICE DOWNTIME ALERT": "hostname service state comment",
    "HOST DOWNTIME ALERT": "hostname state comment",
    "PASSIVE SERVICE CHECK": "hostname service state comment",
    "PASSIVE HOST CHECK": "hostname state comment",
    "SERVICE EVENT HANDLER": "hostname service state statelevel event_handler_name",
    "HOST EVENT HANDLER": "hostname state statelevel event_handler_name",
    "TIMEPERIOD TRANSITION": "service unknown1 unknown2",
}
COMMAND = "EXTERNAL COMMAND"
COMMANDS = {
    "DISABLE_SVC_CHECK": "command hostname service",
    "DISABLE_HOST_CHECK": "command hostname",
    "ENABLE_SVC_CHECK": "command hostname service",
    "ENABLE_HOST_CHECK": "command hostname",
    "PROCESS_SERVICE_CHECK_RESULT": "command hostname service state check_result",
    "PROCESS_HOST_CHECK_RESULT": "command hostname state check_result",
    "SCHEDULE_HOST_DOWNTIME": "command hostname start_time end_time fixed trigger_id duration author comment",
}
OTHER_COMMAND = "command message"

register_pattern("nagios_type", "(?:" + "|".join([*RECORDS, COMMAND]) + ")")
LINE = line_pattern(
    r"\[{nagios_epoch:num}\] (?:Warning:{:space}{_warning:rest}|{nagios_type:nagios_type}: {_rest:rest})"
)


def parse_nagios(df: DataFrame) -> DataFrame:
    """One regex for ``[epoch] TYPE: rest``; the type decides how the rest splits."""
    df = parse(df, LINE, ok="_line")
    command = F.when(F.col("nagios_type") == COMMAND, F.substring_index("_rest", ";", 1))
    kind = F.coalesce(command, "nagios_type")
    df = df.withColumn("_kind", F.when(command.isNotNull() & ~command.isin(*COMMANDS), F.lit("")).otherwise(kind))
    shapes = {kind: names.split() for kind, names in {**RECORDS, **COMMANDS, "": OTHER_COMMAND}.items()}
    names = list(dict.fromkeys(n for fields in shapes.values() for n in fields))
    limit = F.try_element_at(lookup({kind: len(fields) for kind, fields in shapes.items()}), F.col("_kind"))
    # Where each field stands in the line of a kind; -1 where it has none.
    places = {kind: [fields.index(n) if n in fields else -1 for n in names] for kind, fields in shapes.items()}
    # A transition ends with ``;``: the empty field behind it is not the rest.
    rest = F.when(F.col("_kind") == "TIMEPERIOD TRANSITION", F.regexp_replace("_rest", ";$", "")).otherwise(F.col("_rest"))
    df = df.withColumns({"_limit": F.coalesce(limit, F.lit(0)), "_places": F.try_element_at(lookup(places), F.col("_kind"))})
    df = df.withColumn("_cells", F.split(rest, ";", F.col("_limit")))

    full = F.coalesce((F.size("_cells") == F.col("_limit")) | (F.col("_kind") == ""), F.lit(False))
    df = df.withColumns(
        {"_cells": F.when(full, F.col("_cells")), "parsed": F.col("_line") & (full | F.col("_warning").isNotNull())}
    )
    out = {f"nagios_{n}": f"nullif(get(_cells, get(_places, {i})), '')" for i, n in enumerate(names)}
    out["nagios_message"] = f"coalesce(_warning, {out['nagios_message']})"
    numbers = ["attempt", "start_time", "end_time", "fixed", "trigger_id", "duration"]
    out = typed(out, [f"nagios_{n}" for n in numbers])
    out["nagios_epoch"] = F.col("nagios_epoch").try_cast("bigint")
    if "tags" in df.columns:
        df = df.withColumn("tags", failed(F.col("tags"), F.coalesce("parsed", F.lit(False))))
    return df.withColumns(out).drop("_line", "_warning", "_rest", "_kind", "_limit", "_places", "_cells")
