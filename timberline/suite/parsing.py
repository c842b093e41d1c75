"""Parsing, enrichment and assembly queries.

The raw lines are written by Spark from the given tables; the SQL computes the
expected fields from the tables directly, without any regex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.fixtures import lines as L
from timberline.fixtures.shapes import Shapes
from timberline.functions.scalar import (
    FACILITIES,
    SEVERITIES,
    compact_time,
    decode_pri,
    device_time,
    first_time,
    http_time,
    interpolate,
    iso_time,
    url_parts,
)
from timberline.functions.tags import tags_by_type
from timberline.operators import cisco, databases, enrich, firewall, multiline, nagios, quality, syslog, vmware, web, windows
from timberline.operators.locations import locate, networks, range_networks
from timberline.plans.indexing import index_events
from timberline.session import spread, table
from timberline.sources.template import apply_template, prune, prune_mixed
from timberline.suite import query, register


def second(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str) -> Column:
    return F.concat_ws(",", c)


TAG_LIST = "concat_ws(',', tags)"


def duck_list(values: list[str], index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{index} + 1]"


def duck_pri(pri: str) -> str:
    """DuckDB columns of a decoded priority; ``pri`` is a SQL number."""
    return (
        f"cast(floor(({pri}) / 8) as bigint) AS syslog_facility_code, ({pri}) % 8 AS syslog_severity_code, "
        f"{duck_list(FACILITIES, f'cast(floor(({pri}) / 8) as bigint)')} AS syslog_facility, "
        f"{duck_list(SEVERITIES, f'({pri}) % 8')} AS syslog_severity"
    )


def shaped(
    name: str,
    build: Callable,
    job: Callable[[DataFrame], DataFrame],
    shapes: Shapes,
    fields: list[str],
    longs: tuple[str, ...] = (),
    extra: dict[str, tuple[str, str]] | None = None,
) -> None:
    """Register a parse job whose fields a shape defines; ``extra`` adds columns
    as SQL for Spark and for DuckDB."""
    extra = extra or {}

    def run(spark, folder):
        df = job(build(spark, folder))
        return df.select(F.col("ingest_seq").alias("event_id"), *fields, *[F.expr(c).alias(n) for n, (c, _) in extra.items()])

    cols = [f"{shapes.expected(f, 'bigint' if f in longs else 'string')} AS {f}" for f in fields]
    cols += [f"{sql} AS {n}" for n, (_, sql) in extra.items()]
    register(name, run, f"SELECT event_id, {', '.join(cols)} FROM events")


PRI_COLUMNS = ["syslog_facility_code", "syslog_severity_code", "syslog_facility", "syslog_severity"]

# --- system log ---------------------------------------------------------------
_OK = f"NOT ({L.JUNK})"


def when_ok(sql: str, otherwise: str = "NULL") -> str:
    return f"(CASE WHEN {_OK} THEN {sql} ELSE {otherwise} END)"


@query(
    "syslog_parse",
    f"""SELECT event_id, {when_ok(L.PRI)} AS syslog_pri, {when_ok(L.DUCK_STAMP)} AS syslog_timestamp,
    {when_ok(L.HOST)} AS syslog_hostname, {when_ok(L.PROGRAM)} AS syslog_program,
    {when_ok(f"CASE WHEN event_type <> 'purchase' THEN cast(event_id + 1 as varchar) END")} AS syslog_pid,
    {when_ok(L.SYSLOG_TEXT)} AS syslog_message,
    {when_ok(f"{L.DUCK_STAMP} || ' ' || {L.HOST} || ' ' || {L.PROGRAM} || CASE WHEN event_type <> 'purchase' THEN '[' || cast(event_id + 1 as varchar) || ']' ELSE '' END || ': ' || {L.SYSLOG_TEXT}")} AS message_remainder,
    {duck_pri(when_ok(L.PRI, '13'))},
    {when_ok(L.DUCK_SECOND, L.DUCK_SECOND)} AS event_second, 'relay' AS received_from,
    {when_ok(L.HOST, "'relay'")} AS source_host, {when_ok(L.HOST, "'relay'")} AS host,
    {when_ok(L.SYSLOG_TEXT, L.JUNK_TEXT)} AS msg, {when_ok("''", "'_grokparsefailure'")} AS tag_list FROM events""",
)
def syslog_parse(spark, folder):
    df = syslog.parse_syslog(L.syslog_lines(spark, folder))
    return df.select(
        F.col("ingest_seq").alias("event_id"), "syslog_pri", "syslog_timestamp", "syslog_hostname", "syslog_program",
        "syslog_pid", "syslog_message", "message_remainder", *PRI_COLUMNS, second("event_ts").alias("event_second"), "received_from",
        "source_host", "host", "msg", joined("tags").alias("tag_list"),
    )


@query("syslog_pri", f"SELECT pri, {duck_pri('pri')}, count(*) AS n FROM (SELECT event_id % 192 AS pri FROM events) GROUP BY ALL")
def syslog_pri(spark, folder):
    df = table(spark, folder, "events").select((F.col("event_id") % 192).alias("pri"))
    return df.withColumns(decode_pri(F.col("pri"))).groupBy("pri", *PRI_COLUMNS).agg(F.count("*").alias("n"))


shaped(
    "syslog5424_parse", L.rfc5424_lines, syslog.parse_rfc5424, L.RFC5424,
    ["syslog5424_host", "syslog5424_app", "syslog5424_proc", "syslog5424_msgid", "syslog5424_sd", "syslog5424_msg"],
    extra={
        "syslog5424_pri": ("syslog5424_pri", L.PRI),
        "syslog5424_ver": ("syslog5424_ver", "cast(1 as bigint)"),
        "syslog5424_ts": ("syslog5424_ts", "CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END"),
    },
)
_TWO_TIMES = {
    "timestamp": ("timestamp", f"CASE WHEN event_id % 2 = 0 THEN {L.DUCK_STAMP} END"),
    "timestamp8601": ("timestamp8601", "CASE WHEN event_id % 2 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END"),
}
shaped(
    "syslogline_parse", L.generic_lines, syslog.parse_generic, L.GENERIC,
    ["facility", "priority", "logsource", "program", "pid", "line_message"], longs=("facility", "priority", "pid"), extra=_TWO_TIMES,
)


def _only(shapes: Shapes, name: str, cast: str = "string") -> str:
    return f"CASE WHEN event_id % 2 = 0 THEN {shapes.expected(name, cast)} END"


@query(
    "pam_sessions",
    "SELECT event_id, "
    + ", ".join(f"{_only(L.PAM, f)} AS {f}" for f in ["logsource", "program", "pam_module", "pam_caller", "pam_session_state", "username", "pam_by"])
    + ", event_id % 2 = 0 AS parsed FROM events",
)
def pam_sessions(spark, folder):
    df = syslog.parse_pam(L.generic_lines(spark, folder, L.PAM))
    return df.select(
        F.col("ingest_seq").alias("event_id"), "logsource", "program", "pam_module", "pam_caller", "pam_session_state",
        "username", "pam_by", "parsed",
    )


shaped(
    "cron_parse", lambda s, d: L.generic_lines(s, d, L.CRON), syslog.parse_cron, L.CRON,
    ["logsource", "pid", "user", "action", "line_message"], longs=("pid",), extra=_TWO_TIMES,
)
shaped(
    "auth_events", L.login_lines, syslog.parse_logins, L.LOGIN,
    ["username", "src_ip", "port", "logname", "uid", "euid", "tty", "ruser", "remote_host", "user"],
    longs=("port", "uid", "euid"),
    extra={
        "timestamp": ("timestamp", L.DUCK_STAMP),
        "host_target": ("host_target", L.HOST),
        "tag_list": (
            TAG_LIST,
            "(['ssh_brute_force_attack', 'ssh_failed_login', 'ssh_sucessful_login', 'sudo_auth_failure'])[event_id % 4 + 1]",
        ),
    },
)


@query(
    "auth_failures_by_ip",
    f"""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, {L.SRC_IP} AS src_ip, {L.USER} AS username,
    count(*) AS failures, count(*) FILTER (event_id % 4 = 0) AS invalid_users FROM events WHERE event_id % 4 IN (0, 1) GROUP BY ALL""",
)
def auth_failures_by_ip(spark, folder):
    df = syslog.parse_logins(syslog.parse_syslog(L.login_lines(spark, folder)))
    return syslog.login_failures(df).withColumn("bucket", second("bucket"))


@query(
    "alerts",
    f"""SELECT {L.HOST} AS alert_host, 'LogstashAlertTest' AS alert_service, cast(2 as bigint) AS alert_status,
    {L.DUCK_STAMP} || '  ' || {L.HOST} AS alert_message FROM events WHERE event_type = 'signup'""",
)
def alerts(spark, folder):
    return syslog.alerts(syslog.find_canary(L.canary_lines(spark, folder)))


@query(
    "parse_coverage",
    """SELECT 'syslog' AS type, count(*) AS n, count(*) FILTER (event_id % 50 = 0) AS failures,
    round(count(*) FILTER (event_id % 50 = 0) * 100.0 / count(*), 6) AS failure_percent FROM events
    UNION ALL SELECT 'eventlog', count(*), count(*) FILTER (event_id % 50 = 7),
    round(count(*) FILTER (event_id % 50 = 7) * 100.0 / count(*), 6) FROM events""",
)
def parse_coverage(spark, folder):
    a = syslog.parse_syslog(L.syslog_lines(spark, folder)).select("type", "tags")
    b = windows.normalize_eventlog(L.eventlog_lines(spark, folder)).select("type", "tags")
    df = quality.parse_coverage(a.unionByName(b))
    return df.withColumn("failure_percent", F.round("failure_percent", 6))


@query(
    "mark_unfiltered",
    "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '_grokparsefailure' ELSE 'not_filtered' END AS tag_list FROM events",
)
def mark_unfiltered(spark, folder):
    df = quality.mark_unfiltered(syslog.parse_syslog(L.syslog_lines(spark, folder)))
    return df.select(F.col("ingest_seq").alias("event_id"), joined("tags").alias("tag_list"))


@query(
    "interpolate_fields",
    f"SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN 'syslog-' || strftime(ts, '%Y.%m.%d') || ' on ' || {L.HOST} END AS label FROM events",
)
def interpolate_fields(spark, folder):
    df = syslog.parse_syslog(L.syslog_lines(spark, folder)).withColumn("day", F.date_format("event_ts", "yyyy.MM.dd"))
    return df.select(F.col("ingest_seq").alias("event_id"), interpolate("%{type}-%{day} on %{syslog_hostname}").alias("label"))


@query(
    "unmatched_prefixes",
    """SELECT type, prefix, n, cast(row_number() OVER (ORDER BY n DESC, prefix) as bigint) AS rank FROM (
    SELECT 'syslog' AS type, substr('line ' || cast(event_id as varchar) || ' without priority', 1, 7) AS prefix, count(*) AS n
    FROM events WHERE event_id % 50 = 0 GROUP BY ALL) QUALIFY rank <= 10""",
)
def unmatched_prefixes(spark, folder):
    df = syslog.parse_syslog(L.syslog_lines(spark, folder))
    return quality.unmatched_prefixes(df, length=7).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "tag_by_type",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'seen,redhat,syslog' WHEN 1 THEN 'Ready,seen,cisco-asa' WHEN 2 THEN 'Ready,seen,VMware'
    WHEN 3 THEN 'Ready,seen,vCenter' WHEN 4 THEN 'Ready,seen,WindowsEventLog' WHEN 5 THEN 'Ready,seen,apache' WHEN 6 THEN 'Ready,seen,IIS'
    ELSE 'Ready,seen' END AS tag_list FROM events""",
)
def tag_by_type(spark, folder):
    kinds = F.array(*[F.lit(t) for t in ["syslog", "firewall", "VMware", "vCenter", "eventlog", "apache", "iis", "nginx"]])
    df = table(spark, folder, "events").select(
        "event_id",
        F.get(kinds, (F.col("event_id") % 8).cast("int")).alias("type"),
        F.array(F.lit("Ready"), F.lit("seen")).alias("tags"),
    )
    return df.select("event_id", joined(tags_by_type(F.col("type"), F.col("tags"))).alias("tag_list"))


@query(
    "device_tags",
    f"""SELECT event_id, CASE WHEN user_id % 10 < 3 THEN 'Netscaler' WHEN user_id % 10 = 7 THEN 'PFSense' ELSE '' END AS tag_list FROM events""",
)
def device_tags(spark, folder):
    df = L.raw_events(spark, folder, F.lit("x"), "syslog", host=F.expr(L.HOST))
    df = quality.device_tags(df, {"Netscaler": r"^host[0-2]$", "PFSense": r"^host7(\.example\.org)?$"}, host="host")
    return df.select(F.col("ingest_seq").alias("event_id"), joined("tags").alias("tag_list"))


@query(
    "date_parse_formats",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS syslog_time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS firewall_time,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS epoch_time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iis_time,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS iso_time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS mysql_time,
    strftime(ts - INTERVAL '2 hours', '%Y-%m-%d %H:%M:%S') AS http_time,
    CASE WHEN month(ts) = 1 AND day(ts) <= 20 THEN strftime(ts - INTERVAL '10 days', '%Y-%m-%d %H:%M:%S') ELSE strftime(ts - INTERVAL '10 days', '%Y-%m-%d %H:%M:%S') END AS year_before
    FROM events""",
)
def date_parse_formats(spark, folder):
    df = table(spark, folder, "events")
    ts = F.col("ts")
    text = df.select(
        "event_id",
        "ts",
        L.stamp().alias("syslog"),
        F.date_format(ts, "MMM dd yyyy HH:mm:ss").alias("firewall"),
        F.unix_seconds(ts).alias("epoch"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("iis"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss,SSS'Z'").alias("iso"),
        F.date_format(ts, "yyMMdd  H:mm:ss").alias("mysql"),
        F.concat(F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200")).alias("http"),
        # written ten days before arrival: early January arrivals carry a December date
        F.concat_ws(
            " ",
            F.date_format(ts - F.expr("INTERVAL 10 DAYS"), "MMM"),
            F.date_format(ts - F.expr("INTERVAL 10 DAYS"), "d HH:mm:ss"),
        ).alias("early"),
    )
    return text.select(
        "event_id",
        second(device_time(F.col("syslog"), ts)).alias("syslog_time"),
        second(device_time(F.col("firewall"), ts)).alias("firewall_time"),
        second(F.timestamp_seconds("epoch")).alias("epoch_time"),
        second(first_time(F.col("iis"), "yyyy-MM-dd HH:mm:ss")).alias("iis_time"),
        F.date_format(iso_time(F.col("iso")), "yyyy-MM-dd HH:mm:ss.SSS").alias("iso_time"),
        second(compact_time(F.col("mysql"))).alias("mysql_time"),
        second(http_time(F.col("http"))).alias("http_time"),
        second(device_time(F.col("early"), ts)).alias("year_before"),
    )


# --- firewalls ----------------------------------------------------------------
_ASA_FIELDS = cisco.BODY
_FAMILY = {i: "_".join(map(str, ids)) for i, ids in enumerate(cisco.FAMILIES)}
_FAMILY_SQL = "(CASE event_id % 23 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in _FAMILY.items()) + " END)"
_ASA_EXTRA = {
    "asa_family": ("asa_family", _FAMILY_SQL),
    "duration_s": ("duration_s", f"CASE WHEN event_id % 23 = 9 AND {L.OPTIONAL} THEN (event_id % 60) * 60 + user_id % 60 END"),
    "event_second": ("date_format(event_ts, 'yyyy-MM-dd HH:mm:ss')", L.DUCK_SECOND),
    "tag_list": (TAG_LIST, "'cisco-asa'"),
}
shaped("asa_parse", L.asa_lines, cisco.parse_asa, L.ASA, _ASA_FIELDS, tuple(cisco.LONGS), _ASA_EXTRA)


@query(
    "asa_header",
    f"""SELECT event_id, {L.ASA_PRI} AS syslog_pri, {duck_pri(L.ASA_PRI)}, CASE WHEN {L.OPTIONAL} THEN {L.HOST} END AS sysloghost,
    CASE WHEN {L.OPTIONAL} THEN {L.HOST} ELSE 'relay' END AS source_host,
    'ASA-' || cast({L.ASA_LEVEL} as varchar) || '-' || cast({L.ASA_ID} as varchar) AS ciscotag, cast({L.ASA_ID} as bigint) AS asa_id,
    {L.DUCK_SECOND} AS event_second, true AS header FROM events""",
)
def asa_header(spark, folder):
    df = cisco.parse_asa_header(L.asa_lines(spark, folder))
    return df.select(
        F.col("ingest_seq").alias("event_id"), "syslog_pri", *PRI_COLUMNS, "sysloghost", "source_host", "ciscotag", "asa_id",
        second("event_ts").alias("event_second"), "header",
    )


def _flow_sql() -> str:
    parts = [L.ASA.expected(f) for f in ("src_ip", "dst_ip", "dst_port", "protocol")]
    return ", ".join(f"{p} AS {n}" for p, n in zip(parts, ("src_ip", "dst_ip", "dst_port", "protocol")))


_INNER = bytes(b ^ 0x36 for b in b"logstash".ljust(64, b"\0")).hex()
_OUTER = bytes(b ^ 0x5C for b in b"logstash".ljust(64, b"\0")).hex()
_HMAC = (
    f"sha1(unhex('{_OUTER}') || unhex(sha1(unhex('{_INNER}') || encode(src_ip || '|' || dst_ip || '|' || "
    "coalesce(dst_port, '') || '|' || coalesce(protocol, '')))))"
)


@query(
    "flow_fingerprint",
    f"""SELECT event_id, src_ip, dst_ip, cast(dst_port as bigint) AS dst_port, protocol,
    CASE WHEN src_ip IS NOT NULL AND dst_ip IS NOT NULL THEN {_HMAC} END AS fingerprint
    FROM (SELECT event_id, {_flow_sql()} FROM events)""",
)
def flow_fingerprint(spark, folder):
    df = cisco.flow_fingerprint(cisco.parse_asa(L.asa_lines(spark, folder)))
    return df.select(F.col("ingest_seq").alias("event_id"), "src_ip", "dst_ip", "dst_port", "protocol", "fingerprint")


@query(
    "top_flows",
    f"""SELECT src_ip, dst_ip, cast(dst_port as bigint) AS dst_port, protocol, n, {_HMAC} AS fingerprint FROM (
    SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS n FROM (SELECT {_flow_sql()} FROM events)
    WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL GROUP BY ALL)
    ORDER BY n DESC, src_ip, dst_ip, cast(dst_port as bigint) NULLS LAST, protocol LIMIT 10""",
)
def top_flows(spark, folder):
    return cisco.top_flows(cisco.parse_asa(L.asa_lines(spark, folder)))


shaped(
    "netscreen_sessions", L.netscreen_lines, firewall.parse_netscreen, L.NETSCREEN_TAIL,
    ["duration", "policy_id", "service", "proto", "src_zone", "dst_zone", "action", "sent", "rcvd", "src_ip", "dst_ip", "src_port",
     "dst_port", "src_xlated_ip", "src_xlated_port", "dst_xlated_ip", "dst_xlated_port", "session_id", "reason"],
    longs=tuple(firewall.NETSCREEN_LONGS),
    extra={
        "date": ("date", L.DUCK_STAMP),
        "device": ("device", L.HOST),
        "device_id": ("device_id", "'fw' || cast(user_id % 10 as varchar)"),
        "start_time": ("start_time", f"chr(34) || {L.DUCK_SECOND} || chr(34)"),
    },
)
shaped(
    "iptables_parse", L.iptables_lines, firewall.parse_iptables, L.IPTABLES,
    ["iptables_action", "src_ip", "dst_ip", "proto", "src_port", "dst_port"], longs=("src_port", "dst_port"),
    extra={"tag_list": (TAG_LIST, "CASE WHEN event_id % 3 < 2 THEN 'IPTABLES' ELSE '' END")},
)
shaped(
    "ios_parse", L.ios_lines, cisco.parse_ios, L.IOS, ["facility", "severity", "mnemonic", "device_message"], longs=("severity",),
    extra={
        "counter": ("counter", "event_id + 1"),
        "logsource": ("logsource", f"CASE WHEN {L.OPTIONAL} THEN {L.HOST} END"),
        "device_timestamp": ("device_timestamp", L.DUCK_STAMP),
        "program": (
            "program",
            f"CASE WHEN event_id % 3 < 2 THEN '%' || {L.IOS.common['facility']} || '-' || cast(event_id % 8 as varchar) || '-' || {L.IOS.common['mnemonic']} END",
        ),
    },
)
shaped(
    "pan_traffic_filter", L.pan_lines, firewall.parse_pan, L.PAN, ["nas_port"],
    extra={
        "is_traffic": ("is_traffic", "event_id % 2 = 0"),
        "pan_time": ("pan_time", L.DUCK_STAMP),
        "command": (
            "command",
            "'eth' || cast(user_id as varchar) || ',' || cast(event_id as varchar) || CASE WHEN event_id % 2 = 0 THEN ',TRAFFIC,end' ELSE ',THREAT,url' END",
        ),
    },
)

# --- hypervisors, monitoring, databases ---------------------------------------
_VM_FIELDS = ["message_thread_id", "syslog_level", "message_service", "message_opID", "message_service_info", "syslog_message"]
_VM_EXTRA = {
    "syslog_pri": ("syslog_pri", L.PRI),
    "source_host": ("source_host", L.HOST),
    "event_milli": ("date_format(event_ts, 'yyyy-MM-dd HH:mm:ss.SSS')", "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')"),
}
shaped(
    "esxi_parse", L.esxi_lines, vmware.parse_esxi, L.VM, _VM_FIELDS,
    extra={
        **_VM_EXTRA,
        "program": ("program", L.VM.common["program"]),
        "pid": ("pid", f"CASE WHEN {L.OPTIONAL} THEN event_id + 1 END"),
    },
)
shaped("vcenter_parse", L.vcenter_lines, vmware.parse_vcenter, L.VM, _VM_FIELDS, extra=_VM_EXTRA)
shaped(
    "esxi_storage", L.storage_lines, vmware.parse_storage_health, L.STORAGE,
    ["device_naa", "device_status", "datastore_latency_from", "datastore_latency_to", "device_access", "device_id", "datastore", "vmware_warning_msg"],
    longs=("datastore_latency_from", "datastore_latency_to"),
)
_NAGIOS_LONGS = ("nagios_attempt", "nagios_start_time", "nagios_end_time", "nagios_fixed", "nagios_trigger_id", "nagios_duration")
shaped(
    "nagios_parse", L.nagios_lines, nagios.parse_nagios, L.NAGIOS,
    ["nagios_type", "nagios_command", "nagios_hostname", "nagios_service", "nagios_state", "nagios_statetype", "nagios_statecode",
     "nagios_message", "nagios_notifyname", "nagios_contact", "nagios_statelevel", "nagios_attempt", "nagios_comment",
     "nagios_event_handler_name", "nagios_unknown1", "nagios_unknown2", "nagios_check_result", "nagios_start_time", "nagios_end_time",
     "nagios_fixed", "nagios_trigger_id", "nagios_duration", "nagios_author"],
    longs=_NAGIOS_LONGS,
    extra={"nagios_epoch": ("nagios_epoch", "cast(epoch(date_trunc('second', ts)) as bigint)"), "parsed": ("parsed", "true")},
)


@query(
    "redis_log_parse",
    """SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN event_id + 1 END AS pid,
    CASE WHEN event_id % 4 <> 3 THEN strftime(ts, '%d %b %H:%M:%S') END AS timestamp, event_id % 4 <> 3 AS parsed FROM events""",
)
def redis_log_parse(spark, folder):
    df = databases.parse_redis(L.redis_lines(spark, folder))
    return df.select(F.col("ingest_seq").alias("event_id"), "pid", "timestamp", "parsed")


@query(
    "pg_log_parse",
    f"""SELECT event_id, strftime(ts, '%m/%d/%Y %H:%M:%S') AS timestamp, {L.USER} AS user_id,
    'c' || cast(event_id as varchar) || '.' || cast(user_id as varchar) AS connection_id, event_id + 1 AS pid FROM events""",
)
def pg_log_parse(spark, folder):
    df = databases.parse_postgres(L.postgres_lines(spark, folder))
    return df.select(F.col("ingest_seq").alias("event_id"), "timestamp", "user_id", "connection_id", "pid")


# --- web ----------------------------------------------------------------------
_BAD_REQUEST = "page_id % 9 = 4"
_METHOD = "(CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END)"


@query(
    "web_access_parse",
    f"""SELECT page_id, {L.PAGE_IP} AS src_ip, '-' AS ident, CASE WHEN page_id % 3 = 0 THEN 'admin' ELSE '-' END AS auth,
    strftime(make_timestamp(({L.PAGE_TIME}) * 1000000), '%Y-%m-%d %H:%M:%S') AS event_second,
    CASE WHEN {_BAD_REQUEST} THEN NULL ELSE {_METHOD} END AS method, CASE WHEN {_BAD_REQUEST} THEN NULL ELSE {L.PAGE_PATH} END AS request,
    CASE WHEN {_BAD_REQUEST} THEN NULL ELSE '1.1' END AS httpversion, CASE WHEN {_BAD_REQUEST} THEN 'bad request line' END AS rawrequest,
    cast({L.PAGE_STATUS} as bigint) AS response, CASE WHEN page_id % 5 <> 0 THEN length(html) END AS bytes,
    chr(34) || url || chr(34) AS referrer, chr(34) || 'Mozilla/5.0 (X11; rv:' || cast(page_id % 90 as varchar) || '.0)' || chr(34) AS agent,
    {L.PAGE_IP} AS apache_vhost FROM pages""",
)
def web_access_parse(spark, folder):
    df = web.parse_access_log(L.access_lines(spark, folder))
    return df.select(
        F.col("ingest_seq").alias("page_id"), "src_ip", "ident", "auth", second("event_ts").alias("event_second"), "method",
        "request", "httpversion", "rawrequest", "response", "bytes", "referrer", "agent", "apache_vhost",
    )


@query(
    "iis_parse",
    f"""SELECT page_id, strftime(make_timestamp(({L.PAGE_TIME}) * 1000000), '%Y-%m-%d %H:%M:%S') AS event_second,
    'web' || cast(page_id % 5 as varchar) || '.corp' AS source_host, {_METHOD} AS method, {L.PAGE_PATH} AS request,
    CASE WHEN page_id % 3 = 0 THEN '-' ELSE 'q=' || cast(page_id as varchar) END AS cs_query, cast(443 as bigint) AS src_port,
    CASE WHEN page_id % 4 = 0 THEN '-' ELSE 'CORP/u' || cast(page_id as varchar) END AS username, {L.PAGE_IP} AS src_ip,
    'Mozilla/5.0+(X11)' AS agent, cast({L.PAGE_STATUS} as bigint) AS response, cast(0 as bigint) AS sc_subresponse,
    page_id % 7 AS sc_win32_status, page_id * 3 AS time_request FROM pages WHERE page_id % 10 <> 9""",
)
def iis_parse(spark, folder):
    df = web.parse_iis(L.iis_lines(spark, folder))
    return df.select(
        F.col("ingest_seq").alias("page_id"), second("event_ts").alias("event_second"), "source_host", "method", "request", "cs_query",
        "src_port", "username", "src_ip", "agent", "response", "sc_subresponse", "sc_win32_status", "time_request",
    )


@query(
    "url_parts",
    r"""WITH p AS (SELECT page_id, url, split_part(url, '://', 1) AS proto, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
    q AS (SELECT *, split_part(rest, '#', 1) AS body FROM p), r AS (SELECT *, split_part(body, '?', 1) AS hp FROM q)
    SELECT page_id, proto, split_part(split_part(hp, '/', 1), ':', 1) AS host, try_cast(nullif(split_part(split_part(hp, '/', 1), ':', 2), '') as bigint) AS port,
    CASE WHEN strpos(hp, '/') > 0 THEN substr(hp, strpos(hp, '/')) END AS path,
    CASE WHEN strpos(body, '?') > 0 THEN substr(body, strpos(body, '?')) END AS params FROM r""",
)
def url_parts_query(spark, folder):
    return table(spark, folder, "pages").select("page_id", *[c.alias(n) for n, c in url_parts(F.col("url")).items()])


# --- Windows ------------------------------------------------------------------
_GOOD = f"NOT ({L.CORRUPT})"


def good(sql: str) -> str:
    return f"CASE WHEN {_GOOD} THEN {sql} END"


@query(
    "eventlog_normalize",
    f"""SELECT event_id, {good(L.HOST)} AS source_host, {good(f"'account ' || {L.USER}")} AS msg, {good(f"lower({L.SEVERITY_NAME})")} AS eventlog_severity,
    {good("event_id % 5")} AS eventlog_severity_code, {good(L.CHANNEL)} AS eventlog_channel, {good("'Auditing'")} AS eventlog_program,
    {good("'in'")} AS nxlog_input, {good("event_type")} AS eventlog_category, {good(f"cast({L.EVENT_IDS} as bigint)")} AS eventlog_id,
    {good(f"cast({L.EVENT_IDS} as bigint)")} AS "EventID", {good("event_id")} AS eventlog_record_number, {good("user_id + 4")} AS eventlog_pid,
    {good("'sec.evtx'")} AS "FileName", {L.DUCK_SECOND} AS event_second,
    CASE WHEN {_GOOD} THEN 'WindowsEventLog' ELSE 'WindowsEventLog,_grokparsefailure' END AS tag_list FROM events""",
)
def eventlog_normalize(spark, folder):
    df = prune(windows.normalize_eventlog(L.eventlog_lines(spark, folder)), "eventlog")
    return df.select(
        F.col("ingest_seq").alias("event_id"), "source_host", "msg", "eventlog_severity", "eventlog_severity_code", "eventlog_channel",
        "eventlog_program", "nxlog_input", "eventlog_category", "eventlog_id", "EventID", "eventlog_record_number", "eventlog_pid",
        "FileName", second("event_ts").alias("event_second"), joined("tags").alias("tag_list"),
    )


@query(
    "json_decode",
    f"""SELECT event_id, {_GOOD} AS json_ok, cast(json_extract(props, '$.k') as bigint) AS k, {good("event_id")} AS task FROM events""",
)
def json_decode(spark, folder):
    from timberline.sources.channels import decode_json

    props = table(spark, folder, "events").select("event_id", F.col("props").alias("message"))
    k = decode_json(props, "k bigint").select("event_id", "k")
    records = decode_json(L.eventlog_lines(spark, folder), windows.EVENT_SCHEMA)
    task = F.try_variant_get("extra", "$.Task", "bigint")
    records = records.select(F.col("ingest_seq").alias("event_id"), "json_ok", task.alias("task"))
    return records.join(k, "event_id")


@query(
    "typed_projection",
    """SELECT event_id, user_id * 100 AS bytes, CASE WHEN event_id % 7 <> 0 THEN event_id END AS response_time,
    CASE WHEN event_id % 11 <> 0 THEN cast(event_id % 5 as bigint) END AS retries,
    CASE WHEN event_id % 7 = 0 AND event_id % 11 = 0 THEN 'response_time' WHEN event_id % 7 = 0 THEN 'response_time' ELSE '' END AS errors FROM events""",
)
def typed_projection(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id",
        (F.col("user_id") * 100).cast("string").alias("bytes"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE cast(event_id as string) END").alias("response_time"),
        F.expr("CASE WHEN event_id % 11 <> 0 THEN cast(event_id % 5 as string) END").alias("retries"),
    )
    out = apply_template(df)
    return out.select("event_id", "bytes", "response_time", "retries", joined("parse_errors").alias("errors"))


@query(
    "field_prune",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'syslog' WHEN 1 THEN 'apache' WHEN 2 THEN 'VMware' ELSE 'firewall' END AS type,
    CASE WHEN event_id % 4 = 3 THEN 'h' END AS host, CASE WHEN event_id % 4 <> 1 THEN 't' END AS timestamp,
    CASE WHEN event_id % 4 <> 2 THEN 'p' END AS program, CASE WHEN event_id % 4 IN (1, 3) THEN 'm' END AS syslog_message, 'keep' AS msg FROM events""",
)
def field_prune(spark, folder):
    kinds = F.array(*[F.lit(t) for t in ["syslog", "apache", "VMware", "firewall"]])
    df = table(spark, folder, "events").select(
        "event_id", F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("type"), F.lit("h").alias("host"),
        F.lit("t").alias("timestamp"), F.lit("p").alias("program"), F.lit("m").alias("syslog_message"), F.lit("keep").alias("msg"),
    )
    return prune_mixed(df)


# --- enrichment ---------------------------------------------------------------
_GEO_JOIN = (
    "events LEFT JOIN (SELECT n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g "
    "ON user_id % 30 = g.k"
)


def geo_events(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id", F.col("ts").alias("event_ts"), F.expr(L.SRC_IP).alias("src_ip"), F.array().cast("array<string>").alias("tags")
    )
    return enrich.geo_enrich(df, "src_ip", L.ip_blocks(spark, folder))


@query(
    "geo_enrich",
    f"""SELECT event_id, {L.SRC_IP} AS src_ip, CASE WHEN k IS NULL OR k % 3 = 0 THEN NULL ELSE 'City ' || cast(k as varchar) END AS city_name,
    'C' || cast(k as varchar) AS country_code2, n_name AS country_name, r_name AS region_name, cast(NULL as varchar) AS postal_code,
    cast(k * 11 - 130 as double) AS lon, cast(k * 7 - 90 as double) AS lat, CASE WHEN k IS NULL THEN '' ELSE 'geoip' END AS tag_list FROM {_GEO_JOIN}""",
)
def geo_enrich(spark, folder):
    df = enrich.coords(geo_events(spark, folder))
    names = ["city_name", "country_code2", "country_name", "region_name", "postal_code"]
    return df.select(
        "event_id", "src_ip", *[F.col(f"geoip.{n}").alias(n) for n in names], F.get("coords", F.lit(0)).alias("lon"),
        F.get("coords", F.lit(1)).alias("lat"), joined("tags").alias("tag_list"),
    )


_ADDRESSES = """a AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '2001:db8:' || cast(user_id % 40 as varchar) || '::' || cast(event_id % 1000 as varchar)
    WHEN event_id % 11 <> 0 THEN '10.' || cast(user_id % 30 as varchar) || '.' || cast((event_id // 256) % 256 as varchar) || '.' || cast(event_id % 256 as varchar) END AS ip,
    CASE WHEN event_id % 5 = 0 OR event_id % 11 = 0 THEN NULL ELSE (user_id % 30) * 65536 + event_id % 65536 END AS low,
    CASE WHEN event_id % 5 = 0 THEN user_id % 40 END AS six FROM events)"""


@query(
    "geo_longest_prefix",
    f"""WITH {_ADDRESSES}, c AS (SELECT c_custkey, 65536 + c_custkey * 6 AS s, 65536 + c_custkey * 6 + c_custkey % 6 AS e FROM customer)
    SELECT event_id, ip, CASE WHEN c_custkey IS NOT NULL THEN 'customer ' || cast(c_custkey as varchar) WHEN v.n_name IS NOT NULL THEN v.n_name
    WHEN n.n_name IS NOT NULL THEN n.n_name WHEN six IS NOT NULL THEN 'documentation' END AS place
    FROM a LEFT JOIN c ON low BETWEEN s AND e LEFT JOIN nation n ON low // 65536 = n.n_nationkey LEFT JOIN nation v ON six = v.n_nationkey""",
)
def geo_longest_prefix(spark, folder):
    """Ranges of customers side by side inside one network of a nation; networks of nations, IPv6 too, inside wider ones."""
    events = table(spark, folder, "events").select(
        "event_id",
        F.expr(
            """CASE WHEN event_id % 5 = 0 THEN concat('2001:db8:', user_id % 40, '::', event_id % 1000)
            WHEN event_id % 11 <> 0 THEN concat('10.', user_id % 30, '.', (event_id div 256) % 256, '.', event_id % 256) END"""
        ).alias("ip"),
    )
    nation = table(spark, folder, "nation").select("n_name", F.explode(F.expr("array(concat('10.', n_nationkey, '.0.0/16'), concat('2001:db8:', n_nationkey, '::/48'))")).alias("net"))
    wide = spark.range(1).select(F.lit("2001:db8::/32").alias("net"), F.lit("documentation").alias("n_name"))
    start = F.lit(10 << 24).cast("bigint") + 65536 + F.col("c_custkey") * 6
    own = table(spark, folder, "customer").select(
        start.alias("s"), (start + F.col("c_custkey") % 6).alias("e"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name")
    )
    nets = networks(nation.unionByName(wide), "net", "n_name").unionByName(range_networks(own, "s", "e", "name"))
    return locate(events, "ip", nets, "place").select("event_id", "ip", "place")


@query(
    "host_resolve",
    """SELECT event_id, 'host' || cast(user_id as varchar) AS host, coalesce('172.16.' || cast(cast(floor(s_suppkey / 250) as bigint) as varchar) || '.' || cast(s_suppkey % 250 as varchar),
    'host' || cast(user_id as varchar)) AS source_host_ip, 'host' || cast(user_id as varchar) AS reversed
    FROM events LEFT JOIN supplier ON user_id = s_suppkey * 2""",
)
def host_resolve(spark, folder):
    hosts = L.host_inventory(spark, folder)
    df = table(spark, folder, "events").select("event_id", F.expr("'host' || cast(user_id as string)").alias("host"))
    df = enrich.host_resolve(df, "host", hosts).withColumn("reversed", F.col("source_host_ip"))
    return enrich.host_reverse(df, "reversed", hosts)


@query(
    "entity_extract",
    r"""SELECT doc_id, kind, value, count(*) AS n FROM (
    SELECT doc_id, 'ip' AS kind, unnest(regexp_extract_all(text, '(?:^|[^0-9])((?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})[.]){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2}))(?:[^0-9]|$)', 1)) AS value FROM documents
    UNION ALL SELECT doc_id, 'uuid', unnest(regexp_extract_all(text, '[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}')) FROM documents
    UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+.-]*://[^ \t\n\r\f/?#"<>]+(?:/[/A-Za-z0-9._~%!$&''()*+,;=:@-]*)?(?:[?][/?A-Za-z0-9._~%!$&''()*+,;=:@-]*)?(?:#[/?A-Za-z0-9._~%!$&''()*+,;=:@-]*)?')) FROM documents
    UNION ALL SELECT doc_id, 'user', unnest(regexp_extract_all(text, '[a-zA-Z0-9._-]+@[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})+')) FROM documents
    ) GROUP BY ALL""",
)
def entity_extract(spark, folder):
    found = quality.entities(spread(table(spark, folder, "documents").select("doc_id", "text")), "text")
    return found.groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


@query(
    "loglevel_counts",
    r"""SELECT CASE word WHEN 'warn' THEN 'warning' WHEN 'err' THEN 'error' WHEN 'crit' THEN 'critical' WHEN 'emerg' THEN 'emergency' ELSE word END AS level, count(*) AS n FROM (
    SELECT nullif(lower(regexp_extract('host said ' || event_type || ' ' || text, '(?i)\b(alert|trace|debug|notice|info|warn(?:ing)?|err(?:or)?|crit(?:ical)?|fatal|severe|emerg(?:ency)?)\b', 1)), '') AS word
    FROM (SELECT event_type, CASE event_id % 9 WHEN 0 THEN 'WARN' WHEN 1 THEN 'Critical' WHEN 2 THEN 'emerg' WHEN 3 THEN 'inform' WHEN 4 THEN 'Err' ELSE 'none' END AS text FROM events)
    UNION ALL SELECT nullif(lower(regexp_extract(text, '(?i)\b(alert|trace|debug|notice|info|warn(?:ing)?|err(?:or)?|crit(?:ical)?|fatal|severe|emerg(?:ency)?)\b', 1)), '') FROM documents) GROUP BY ALL""",
)
def loglevel_counts(spark, folder):
    words = "(CASE event_id % 9 WHEN 0 THEN 'WARN' WHEN 1 THEN 'Critical' WHEN 2 THEN 'emerg' WHEN 3 THEN 'inform' WHEN 4 THEN 'Err' ELSE 'none' END)"
    lines = table(spark, folder, "events").select(F.expr(f"'host said ' || event_type || ' ' || {words}").alias("message"))
    docs = table(spark, folder, "documents").select(F.col("text").alias("message"))
    return quality.log_level(lines.unionByName(docs)).groupBy("level").agg(F.count("*").alias("n"))


# --- assembly -----------------------------------------------------------------
_DOC_LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    marked AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN line ELSE '--> ' || line END AS message FROM lines),
    grouped AS (SELECT *, coalesce(max(CASE WHEN strpos(message, '-->') = 0 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS start FROM marked)"""


@query(
    "multiline_assemble",
    f"""WITH {_DOC_LINES} SELECT 'doc' || cast(doc_id as varchar) AS host, cast(start as bigint) AS ingest_seq, 'VMware' AS type,
    count(*) AS n_lines, md5(string_agg(message, chr(10) ORDER BY pos)) AS digest FROM grouped GROUP BY doc_id, start""",
)
def multiline_assemble(spark, folder):
    df = multiline.assemble(L.document_lines(spark, folder), "host", "ingest_seq", "-->")
    return df.select("host", "ingest_seq", "type", "n_lines", F.md5("message").alias("digest"))


@query(
    "split_lines",
    """SELECT doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as bigint) AS line_no, md5(unnest(string_split(text, chr(10)))) AS digest FROM documents""",
)
def split_lines(spark, folder):
    df = multiline.split_lines(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return df.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5("text").alias("digest"))


@query(
    "mysql_slow",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    m AS (SELECT doc_id, pos, cast(floor(pos / 4) as bigint) * 4 AS start, CASE WHEN pos % 4 = 0 THEN '24010' || cast(1 + doc_id % 9 as varchar) || '  7:0' || cast(doc_id % 10 as varchar) || ':30 ' || line ELSE ' ' || line END AS message FROM l)
    SELECT 'db' || cast(doc_id as varchar) AS host, start AS ingest_seq, cast(pos - start as bigint) AS line_no, md5(message) AS digest,
    '2024-01-0' || cast(1 + doc_id % 9 as varchar) || ' 07:0' || cast(doc_id % 10 as varchar) || ':30' AS event_second FROM m""",
)
def mysql_slow(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = "'24010' || cast(1 + doc_id % 9 as string) || '  7:0' || cast(doc_id % 10 as string) || ':30 ' || line"
    df = docs.select(
        F.expr("'db' || cast(doc_id as string)").alias("host"),
        F.col("pos").cast("bigint").alias("ingest_seq"),
        F.expr(f"CASE WHEN pos % 4 = 0 THEN {head} ELSE ' ' || line END").alias("message"),
    )
    out = databases.parse_mysql_slow(df)
    return out.select(
        "host", "ingest_seq", F.col("line_no").cast("bigint").alias("line_no"), F.md5("message").alias("digest"),
        second("event_ts").alias("event_second"),
    )


# --- the whole indexing job ---------------------------------------------------
@query(
    "index_all_types",
    f"""WITH e AS (SELECT strftime(ts, '%Y.%m.%d') AS d, event_id FROM events), p AS (SELECT strftime(make_timestamp(({L.PAGE_TIME}) * 1000000), '%Y.%m.%d') AS d, page_id FROM pages)
    SELECT 'syslog' AS type, 'redhat-' || d AS index_name, count(*) AS n, count(*) FILTER (event_id % 50 = 0) AS failures FROM e GROUP BY d
    UNION ALL SELECT 'firewall', 'logstash-' || d, count(*), 0 FROM e GROUP BY d
    UNION ALL SELECT 'VMware', 'logstash-' || d, count(*), 0 FROM e GROUP BY d
    UNION ALL SELECT 'vCenter', 'logstash-' || d, count(*), 0 FROM e GROUP BY d
    UNION ALL SELECT 'eventlog', 'logstash-' || d, count(*), count(*) FILTER (event_id % 50 = 7) FROM e GROUP BY d
    UNION ALL SELECT 'apache', 'logstash-' || d, count(*), 0 FROM p GROUP BY d
    UNION ALL SELECT 'iis', 'logstash-' || d, count(*), 0 FROM p WHERE page_id % 10 <> 9 GROUP BY d""",
)
def index_all_types(spark, folder):
    from timberline.functions.extract import FAILURE_TAG

    builders = {
        "syslog": L.syslog_lines, "firewall": L.asa_lines, "VMware": L.esxi_lines, "vCenter": L.vcenter_lines,
        "eventlog": L.eventlog_lines, "apache": L.access_lines, "iis": L.iis_lines,
    }
    events = index_events({kind: build(spark, folder) for kind, build in builders.items()})
    return events.groupBy("type", "index_name").agg(
        F.count("*").alias("n"), F.count_if(F.array_contains("tags", FAILURE_TAG)).alias("failures")
    )


@query(
    "index_mixed_devices",
    """WITH e AS (SELECT event_id, event_type FROM events)
    SELECT 'firewall' AS type, 'asa' AS device, count(*) AS n, 0 AS failures FROM e
    UNION ALL SELECT 'firewall', 'netscreen', count(*), 0 FROM e
    UNION ALL SELECT 'firewall', 'ios', count(*), 0 FROM e WHERE event_id % 3 < 2
    UNION ALL SELECT 'firewall', 'other', count(*), count(*) FROM e WHERE event_id % 3 = 2
    UNION ALL SELECT 'syslog', 'iptables', count(*), count(*) FROM e WHERE event_id % 3 < 2
    UNION ALL SELECT 'syslog', 'canary', count(*), count(*) FROM e WHERE event_type = 'signup'
    UNION ALL SELECT 'syslog', 'other', sum(n), sum(failures) FROM (
      SELECT count(*) AS n, count(*) FILTER (event_id % 50 = 0) AS failures FROM e
      UNION ALL SELECT count(*), count(*) FROM e WHERE event_id % 3 = 2 UNION ALL SELECT count(*), count(*) FROM e WHERE event_type <> 'signup')""",
)
def index_mixed_devices(spark, folder):
    """Lines of several devices in one type go to their own parsers; packet-filter lines have no priority, so their header does not parse."""
    from timberline.functions.extract import FAILURE_TAG

    union = lambda kind, *builders: reduce(DataFrame.unionByName, [b(spark, folder).withColumn("type", F.lit(kind)) for b in builders])
    raw = {
        "firewall": union("firewall", L.asa_lines, L.netscreen_lines, L.ios_lines),
        "syslog": union("syslog", L.syslog_lines, L.iptables_lines, L.canary_lines),
    }
    device = F.when(F.col("ciscotag").isNotNull(), "asa").when(F.col("session_id").isNotNull(), "netscreen").when(F.col("mnemonic").isNotNull(), "ios")
    device = device.when(F.col("iptables_action").isNotNull(), "iptables").when(F.col("nagios_service").isNotNull(), "canary").otherwise("other")
    events = index_events(raw).groupBy("type", device.alias("device"))
    return events.agg(F.count("*").alias("n"), F.count_if(F.array_contains("tags", FAILURE_TAG)).alias("failures"))
