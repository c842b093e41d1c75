"""Raw channel events to searchable events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import once
from timberline.functions.scalar import device_time
from timberline.functions.tags import has_tag, tags_by_type
from timberline.operators.cisco import flow_fingerprint, parse_asa, parse_ios
from timberline.operators.databases import MYSQL_CONTINUATION, parse_mysql_entries, parse_postgres, parse_redis
from timberline.operators.enrich import geo_enrich, host_resolve
from timberline.operators.firewall import parse_iptables, parse_netscreen, parse_pan
from timberline.operators.multiline import assemble
from timberline.operators.nagios import parse_nagios
from timberline.operators.quality import device_tags
from timberline.operators.syslog import find_canary, parse_logins, parse_syslog
from timberline.operators.vmware import parse_esxi, parse_storage_health, parse_vcenter
from timberline.operators.web import parse_access_log, parse_iis
from timberline.operators.windows import normalize_eventlog
from timberline.sources.storage import route
from timberline.sources.template import apply_template, prune


def _timed(df: DataFrame, when: Column | None = None) -> DataFrame:
    """The event's own time, or that of its arrival; host and text under their common names."""
    own = F.col("event_ts") if "event_ts" in df.columns else F.lit(None).cast("timestamp")
    time = F.coalesce(when if when is not None else own, "received_at")
    return df.withColumns({"event_ts": time, "source_host": F.col("host"), "msg": F.col("message")})


#: Fields of packet-filter lines, which take precedence over those of logins.
PACKET = ["iptables_action", "src_ip", "dst_ip", "proto", "src_port", "dst_port"]


def _parse_syslog(df: DataFrame) -> DataFrame:
    """BSD lines, logins, packet-filter lines of the kernel, and the canary of the monitoring."""
    df = find_canary(df).select(*(c for c in df.columns if c != "tags"), "tags", "nagios_service")
    df = parse_iptables(df).drop("parsed").withColumnsRenamed({c: f"_{c}" for c in PACKET})
    df = parse_logins(parse_syslog(df))
    found = {c: F.coalesce(F.col(f"_{c}"), F.col(c).cast(df.schema[f"_{c}"].dataType)) if c in df.columns else F.col(f"_{c}") for c in PACKET}
    return df.withColumns(found).drop(*(f"_{c}" for c in PACKET))


#: Kinds of firewall lines, by a text that only they hold; all others are the security appliance's.
FIREWALLS = {
    "netscreen": (lambda line: line.contains("NetScreen device_id="), lambda df: _timed(parse_netscreen(df), device_time(F.col("date"), F.col("received_at")))),
    "ios": (
        lambda line: line.rlike("%[A-Z0-9_]+-[0-7]-[A-Z0-9_]+:") & ~line.contains("%ASA-"),
        lambda df: _timed(parse_ios(df), device_time(F.col("device_timestamp"), F.col("received_at"))),
    ),
    "pan": (lambda line: line.contains(",TRAFFIC,"), lambda df: _timed(parse_pan(df))),
}


def _parse_firewall(df: DataFrame) -> DataFrame:
    """Each kind of device by its own parser, in one pass; columns of one name take the type that they have for the appliance.

    A parser sees the lines of its kind only, the others as NULL.  One filtered branch for each kind would read,
    deal out and build every line again, and its filter would move to the few tasks that read the files.
    """
    line, kind = F.coalesce("message", F.lit("")), F.lit("")
    for name, (is_kind, _) in reversed(FIREWALLS.items()):
        kind = F.when(is_kind(line), name).otherwise(kind)
    df = once(df, "_kind", kind)
    given = {c: f"_given_{c}" for c in df.columns if c != "_kind"}
    df = df.select("_kind", *(F.col(c).alias(n) for c, n in given.items()))
    parsers = {"": lambda df: flow_fingerprint(parse_asa(df)), **{name: parser for name, (_, parser) in FIREWALLS.items()}}
    found: dict[str, dict[str, str]] = {}  # of each column, the kinds that have it and its name in this table
    types: dict[str, str] = {}
    for name, parser in parsers.items():
        mine = {c: F.col(n) for c, n in given.items()} | {"message": F.when(F.col("_kind") == name, F.col(given["message"]))}
        kept = df.columns
        df = parser(df.withColumns(mine))
        fields = [(c, t) for c, t in df.dtypes if c not in kept]
        cells = [F.col(c) if types.setdefault(c, t) == t else F.col(c).try_cast(types[c]) for c, t in fields]
        df = df.select(*kept, *(cell.alias(f"_{name}_{c}") for cell, (c, _) in zip(cells, fields)))
        for c, _ in fields:
            found.setdefault(c, {})[name] = f"_{name}_{c}"

    def own(column: str) -> Column:
        value = F.lit(None).cast(types[column])
        for name, cell in found[column].items():
            value = F.when(F.col("_kind") == name, F.col(cell)).otherwise(value)
        return value

    return df.select(*(own(c).alias(c) for c in found))


PARSERS = {
    "syslog": _parse_syslog,
    "firewall": _parse_firewall,
    "VMware": lambda df: parse_storage_health(parse_esxi(df)),
    "vCenter": parse_vcenter,
    "eventlog": normalize_eventlog,
    "apache": parse_access_log,
    "nginx": parse_access_log,
    "iis": parse_iis,
    "nagios": lambda df: _timed(parse_nagios(df), F.timestamp_seconds("nagios_epoch")),
    "mysql-slowquery": lambda df: _timed(parse_mysql_entries(df)),
    "redis": lambda df: _timed(parse_redis(df)),
    "postgres": lambda df: _timed(parse_postgres(df)),
}

#: Types whose lines are assembled first: what tells a line that goes on with the event before it.
MULTILINE = {"VMware": "-->", "mysql-slowquery": MYSQL_CONTINUATION}

#: Types whose source address is located when address ranges are given; of syslog, packet-filter lines alone.
LOCATED = ("firewall", "apache", "nginx", "iis", "syslog")


def parse_other(df: DataFrame) -> DataFrame:
    """Events that no rule knows: kept as they came, at the time they arrived."""
    return df.withColumns({"event_ts": F.col("received_at"), "source_host": F.col("host"), "msg": F.col("message")})


def parse_type(
    raw: DataFrame,
    source_type: str,
    blocks: DataFrame | None = None,
    hosts: DataFrame | None = None,
    devices: Mapping[str, str] | None = None,
    assembled: bool = False,
) -> DataFrame:
    """Tag, assemble, parse, enrich, type and prune the events of one type.

    On a bronze table partitioned by ``type`` the filter picks the type's folders.  Without the
    tables of address ranges (``blocks``) and of hosts all steps but the assembly are narrow; lines that
    are ``assembled`` already are taken as they are.  ``devices`` are tags by patterns of host names.
    """
    df = raw.filter(F.col("type") == source_type)
    if source_type in MULTILINE and not assembled:
        # files order their own lines; other intakes order those of a host
        key = "source_file" if "source_file" in df.columns else "host"
        df = assemble(df, key, "ingest_seq", MULTILINE[source_type]).drop("n_lines")
    df = PARSERS[source_type](df.withColumn("tags", tags_by_type(F.col("type"), F.col("tags"))))
    return _finish(df, source_type, blocks, hosts, devices)


def _finish(df: DataFrame, source_type: str, blocks: DataFrame | None, hosts: DataFrame | None, devices: Mapping[str, str] | None) -> DataFrame:
    if blocks is not None and source_type in LOCATED:
        of = F.when(has_tag(F.col("tags"), "IPTABLES"), F.col("src_ip")) if source_type == "syslog" else F.col("src_ip")
        df = geo_enrich(df.withColumn("_located", of), "_located", blocks).drop("_located")
    if hosts is not None:
        df = host_resolve(df, "source_host", hosts)
    if devices:
        df = device_tags(df, dict(devices))
    return prune(apply_template(df), source_type)


def index_events(
    raw: DataFrame | Mapping[str, DataFrame],
    types: Sequence[str] | None = None,
    blocks: DataFrame | None = None,
    hosts: DataFrame | None = None,
    devices: Mapping[str, str] | None = None,
    assembled: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """All events as one wide table with family, day and index name.

    ``raw`` is one table of all types, or one table per type.  Types without a parser, and a NULL
    type, go to the default family unparsed: every row in is a row out, but for the
    ``#`` header lines of IIS and the lines of the types that are assembled first.  ``assembled`` holds
    the events of such types that something else, as a stream, has put together.
    """
    extra, done = (blocks, hosts, devices), assembled or {}
    frames = [parse_type(df, t, *extra, assembled=True) for t, df in done.items()]
    if isinstance(raw, Mapping):
        frames += [parse_type(raw[t], t, *extra) for t in types or raw if t in PARSERS]
        others = [raw[t] for t in types or raw if t not in PARSERS]
    else:
        frames += [parse_type(raw, t, *extra) for t in types or PARSERS if t not in done]  # each type is a filtered read
        known = F.coalesce(F.col("type").isin(*(types or PARSERS)), F.lit(False))
        others = [raw.filter(~known)] if types is None else []
    frames += [_finish(parse_other(df), "", *extra) for df in others]
    return route(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))
