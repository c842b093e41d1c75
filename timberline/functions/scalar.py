"""Scalar column builders: priority, dates, addresses, URLs, flow hash."""

from __future__ import annotations

import datetime as dt

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.extract import lookup
from timberline.functions.grammar import block

# RFC 5424 tables 1 and 2, with the labels log indexers use.
FACILITIES = [
    "kernel", "user-level", "mail", "daemon", "security/authorization", "syslogd",
    "line printer", "network news", "uucp", "clock", "security/authorization", "ftp",
    "ntp", "log audit", "log alert", "clock",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
]
SEVERITIES = [
    "emergency", "alert", "critical", "error",
    "warning", "notice", "informational", "debug",
]
DEFAULT_PRI = 13  # RFC 3164 4.3.3: user-level notice when a line has no priority


def decode_pri(pri: Column, default: int | None = DEFAULT_PRI) -> dict[str, Column]:
    """Facility and severity, as code and label, of a priority (text or number)."""
    value = pri.try_cast("int")
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    facility, severity = F.floor(value / 8).cast("int"), value % 8
    return {
        "syslog_facility_code": facility.cast("bigint"),
        "syslog_severity_code": severity.cast("bigint"),
        "syslog_facility": F.try_element_at(lookup(dict(enumerate(FACILITIES))), facility),
        "syslog_severity": F.try_element_at(lookup(dict(enumerate(SEVERITIES))), severity),
    }


def single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def first_time(text: Column, *formats: str) -> Column:
    """The first format that parses; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


#: How far ahead of its arrival a line's own time is believed.
CLOCK_AHEAD = dt.timedelta(days=1)
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def device_time(text: Column, received_at: Column) -> Column:
    """``MMM d [yyyy] HH:mm:ss``; a missing year comes from the arrival time.

    The arrival year is used unless that puts the event more than a day after
    its arrival (a December line that arrives in January): then the year before.
    A trailing zone word is ignored, as the devices log in UTC.  Taken apart by
    hand, since a date format parser costs more than the line's regex.
    """
    word = F.split(text, " +")
    name, day, third, fourth = (F.get(word, F.lit(i)) for i in range(4))
    at = F.instr(F.lit(MONTHS), F.substring(name, 1, 3))
    month = F.when(at % 3 == 1, F.floor(at / 3).cast("int") + 1)
    dated = ~third.contains(":")
    clock = F.split(F.when(dated, fourth).otherwise(third), "[:.,]")
    rest = [month, day.try_cast("int"), *[F.get(clock, F.lit(i)).try_cast("int") for i in range(3)]]
    year = F.year(received_at)
    this_year = F.try_make_timestamp(F.when(dated, third.try_cast("int")).otherwise(year), *rest)
    fits = dated | (this_year <= received_at + F.expr("INTERVAL 1 DAY"))
    return F.when(fits, this_year).otherwise(F.try_make_timestamp(year - 1, *rest))


def iso_time(text: Column) -> Column:
    """ISO 8601 with a ``T`` or a blank, ``,`` or ``.`` before the fraction; UTC."""
    return F.regexp_replace(text, ",", ".").try_cast("timestamp")


def http_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def compact_time(text: Column) -> Column:
    """``yyMMdd H:mm:ss`` with any number of blanks between the parts."""
    return F.try_to_timestamp(single_blanks(text), F.lit("yyMMdd H:mm:ss"))


def seconds_of(clock: Column) -> Column:
    """``HH:MM:SS`` (hours may exceed 24) as seconds."""
    part = F.split(clock, ":")
    h, m, s = (F.get(part, F.lit(i)).try_cast("bigint") for i in range(3))
    return h * 3600 + m * 60 + s


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; NULL for anything else."""
    part = F.split(ip, "[.]")
    a, b, c, d = (F.get(part, F.lit(i)).try_cast("bigint") for i in range(4))
    return F.when(ip.rlike(f"^{block('ipv4')}$"), ((a * 256 + b) * 256 + c) * 256 + d)


def flow_hash(*values: Column, key: str) -> Column:
    """Keyed SHA-1 (RFC 2104) of the values joined by ``|``; absent ones are empty.

    Written with ``sha1`` over constant pads, so no Python runs per row.
    """
    secret = key.encode().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    text = F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])
    digest = F.sha1(F.concat(inner, F.encode(text, "UTF-8")))
    return F.sha1(F.concat(outer, F.unhex(digest)))


def url_parts(url: Column) -> dict[str, Column]:
    """Protocol, host, port, path and parameters of a URL."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z+]*://", "")
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    authority = F.regexp_replace(authority, r"^.*@", "")
    tail = F.regexp_replace(rest, r"^[^/?#]*", "")

    def some(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    return {
        "proto": some(F.regexp_extract(url, r"^([A-Za-z][A-Za-z+]*)://", 1)),
        "host": some(F.regexp_replace(authority, r":[0-9]+$", "")),
        "port": some(F.regexp_extract(authority, r":([0-9]+)$", 1)).try_cast("bigint"),
        "path": some(F.regexp_extract(tail, r"^[^?#]*", 0)),
        "params": some(F.regexp_extract(tail, r"^[^?#]*(\?[^#]*)", 1)),
    }


def interpolate(template: str) -> Column:
    """Text with ``%{field}`` marks; NULL when a field is NULL."""
    pieces = re.split(r"%\{([^}]+)\}", template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(pieces)])
