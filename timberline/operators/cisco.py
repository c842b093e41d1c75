"""Cisco ASA firewall messages (23 families) and IOS device lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import SEP, clean, layout_of, lookup, once, parse, part, rewrite, typed
from timberline.functions.grammar import line_pattern, register_pattern
from timberline.functions.scalar import decode_pri, device_time, flow_hash, seconds_of
from timberline.functions.tags import failed, has_tag

# Words the devices use.
register_pattern(
    "asa_action",
    "(?:Built|Teardown|Deny|Denied|denied by ACL|denied|requested|permitted"
    "|discarded|est-allowed|Dropping|created|deleted)",
)
register_pattern("asa_direction", "(?:[Ii]nbound|[Oo]utbound)")
register_pattern("asa_reason", r"\w(?:[\w\s]*\w)?")
register_pattern("asa_interval", "(?:first hit|{:int}-second interval)")
register_pattern("asa_xlate", "(?:static|dynamic)")
register_pattern("token", r"[^\s(),/:\]]+")


def _user(name: str) -> str:
    return rf"(?:\({{{name}:data}}\))?"


def _address(side: str, user: str = "fwuser") -> str:
    return f"{{{side}_ip:ip}}/{{{side}_port:int}}"


def _endpoint(side: str) -> str:
    return f"{{{side}_interface:data}}:{_address(side)}"


_HASHES = r"\[{hashcode1:data}, {hashcode2:data}\]"

# Message ids -> text of the family, as the devices write it.
FAMILIES = {
    (106001,): r"{direction:asa_direction} {protocol:word} connection {action:asa_action} from "
    + _address("src") + " to " + _address("dst") + " flags {tcp_flags:rest} on interface {interface:notspace}",
    (106006, 106007, 106010): r"{action:asa_action} {direction:asa_direction} {protocol:word} (?:from|src) "
    + _address("src") + _user("src_fwuser") + " (?:to|dst) " + _address("dst") + _user("dst_fwuser")
    + " (?:on interface {interface:notspace}|due to {reason:asa_reason})",
    (106014,): r"{action:asa_action} {direction:asa_direction} {protocol:word} src {src_interface:data}:{src_ip:ip}"
    + _user("src_fwuser") + " dst {dst_interface:data}:{dst_ip:ip}" + _user("dst_fwuser")
    + r" \(type {icmp_type:int}, code {icmp_code:int}\)",
    (106015,): r"{action:asa_action} {protocol:word} \({policy_id:data}\) from " + _address("src") + " to "
    + _address("dst") + r" flags {tcp_flags:data} {1,2}on interface {interface:notspace}",
    (106021,): r"{action:asa_action} {protocol:word} reverse path check from {src_ip:ip} to {dst_ip:ip} "
    r"on interface {interface:notspace}",
    (106023,): r"{action:asa_action} {protocol:word} src {src_interface:data}:{src_ip:ip}(?:/{src_port:int})?"
    + _user("src_fwuser") + " dst {dst_interface:data}:{dst_ip:ip}(?:/{dst_port:int})?" + _user("dst_fwuser")
    + r"(?: \(type {icmp_type:int}, code {icmp_code:int}\))? by access-group {policy_id:data} " + _HASHES,
    (106100,): r"access-list {policy_id:word} {action:asa_action} {protocol:word} {src_interface:data}/{src_ip:ip}"
    r"\({src_port:int}\)" + _user("src_fwuser") + r" -> {dst_interface:data}/{dst_ip:ip}\({dst_port:int}\)"
    + _user("dst_fwuser") + " hit-cnt {hit_count:int} {interval:asa_interval} " + _HASHES,
    (110002,): r"{reason:asa_reason} for {protocol:word} from " + _endpoint("src") + " to " + _address("dst"),
    (302010,): r"{connection_count:int} in use, {connection_count_max:int} most used",
    (302013, 302014, 302015, 302016): r"{action:asa_action}(?: {direction:asa_direction})? {protocol:word} connection "
    r"{connection_id:int} for " + _endpoint("src") + r"(?: \({src_mapped_ip:ip}/{src_mapped_port:int}\))?"
    + _user("src_fwuser") + " to " + _endpoint("dst") + r"(?: \({dst_mapped_ip:ip}/{dst_mapped_port:int}\))?"
    + _user("dst_fwuser") + r"(?: duration {duration:clock} bytes {bytes:int})?(?: {reason:asa_reason})?"
    r"(?: \({user:data}\))?",
    (302020, 302021): r"{action:asa_action}(?: {direction:asa_direction})? {protocol:word} connection for "
    r"faddr {dst_ip:ip}/{icmp_seq_num:int}(?:\({fwuser:data}\))? gaddr {src_xlated_ip:ip}/{icmp_code_xlated:int} "
    r"laddr {src_ip:ip}/{icmp_code:int}(?: \({user:data}\))?",
    (305011,): r"{action:asa_action} {xlate_type:asa_xlate} {protocol:word} translation from "
    r"{src_interface:data}:{src_ip:ip}(?:/{src_port:int})?" + _user("src_fwuser")
    + " to {src_xlated_interface:data}:{src_xlated_ip:ip}/{src_xlated_port:int}",
    (313001, 313004, 313008): r"{action:asa_action} {protocol:word} type={icmp_type:int}, code={icmp_code:int} "
    r"from {src_ip:ip} on interface {interface:notspace}(?: to {dst_ip:ip})?",
    (313005,): r"{reason:asa_reason} for {protocol:word} error message: {err_protocol:word} "
    r"src {err_src_interface:data}:{err_src_ip:ip}" + _user("err_src_fwuser")
    + " dst {err_dst_interface:data}:{err_dst_ip:ip}" + _user("err_dst_fwuser")
    + r" \(type {err_icmp_type:int}, code {err_icmp_code:int}\) on {interface:data} interface\. +"
    r"Original IP payload: {orig_protocol:word} src {orig_src_ip:ip}/{orig_src_port:int}" + _user("orig_src_fwuser")
    + " dst {orig_dst_ip:ip}/{orig_dst_port:int}" + _user("orig_dst_fwuser"),
    (402117,): r"{protocol:word}: Received a non-IPSec packet \(protocol= {orig_protocol:word}\) "
    r"from {src_ip:ip} to {dst_ip:ip}",
    (402119,): r"{protocol:word}: Received an {orig_protocol:word} packet \(SPI= {spi:data}, "
    r"sequence number= {seq_num:data}\) from {src_ip:ip} \(user= {user:data}\) to {dst_ip:ip} "
    r"that failed anti-replay checking",
    (419001,): r"{action:asa_action} {protocol:word} packet from " + _endpoint("src") + " to " + _endpoint("dst")
    + ", reason: {reason:rest}",
    (419002,): r"{reason:asa_reason} from " + _endpoint("src") + " to " + _endpoint("dst")
    + " with different initial sequence number",
    (500004,): r"{reason:asa_reason} for protocol={protocol:word}, from " + _address("src") + " to " + _address("dst"),
    (602303, 602304): r"{protocol:word}: An {direction:asa_direction} {tunnel_type:rest} SA \(SPI= {spi:data}\) "
    r"between {src_ip:ip} and {dst_ip:ip} \(user= {user:data}\) has been {action:asa_action}",
    (710001, 710002, 710003, 710005, 710006): r"{protocol:word} (?:request|access) {action:asa_action} from "
    + _address("src") + " to " + _endpoint("dst"),
    (713172,): r"Group = {group:rest}, IP = {src_ip:ip}, Automatic NAT Detection Status:\s+Remote end\s*"
    r"{is_remote_natted:data}\s*behind a NAT device\s+This\s+end\s*{is_local_natted:data}\s*behind a NAT device",
    (733100,): r"(?<!\[)\[\s*{drop_type:data}\s*\] drop {drop_rate_id:data} exceeded\. "
    r"Current burst rate is {drop_rate_current_burst:int} per second, max configured rate is {drop_rate_max_burst:int}; "
    r"Current average rate is {drop_rate_current_avg:int} per second, max configured rate is {drop_rate_max_avg:int}; "
    r"Cumulative total count is {drop_total_count:int}",
}

_HEADER = r"<{syslog_pri:pri}>{timestamp:ciscotime}(?: {sysloghost:iporhost})?: %"
HEADER = line_pattern(_HEADER + "{ciscotag:ciscotag}:", at_start=True)
# A reason takes all words of a run, so a search need only start where a run does.
_RUN = r"(?<![\w\s])\s*"
_ANY = [line_pattern((_RUN if text.startswith("{reason:") else "") + text) for text in FAMILIES.values()]
# The id leads its family's alternative; the last one takes any other id.
register_pattern("asa_level", "[A-Z0-9]+-[0-9]+-")
register_pattern("asa_other", "[A-Z0-9_]+")
_ALTERNATIVES = []
for _ids, _text in FAMILIES.items():
    _name = "asa_" + "_".join(map(str, _ids))
    register_pattern(_name, f"(?:{'|'.join(map(str, _ids))})")
    _ALTERNATIVES.append(f"{{_id:{_name}}}: {_text}")
_BY_ID = line_pattern(
    _HEADER + "{_level:asa_level}" + f"(?:{'|'.join(_ALTERNATIVES)}|{{_other:asa_other}}:)", at_start=True
)
BODY = layout_of(_ANY)
LONGS = [
    n
    for n in BODY
    if n.endswith("_port")
    or n.startswith(("icmp_", "err_icmp_", "connection_", "drop_rate_current", "drop_rate_max"))
    or n in ("hit_count", "bytes", "drop_total_count")
]

IOS = line_pattern(
    r"{counter:num}?: (?:{logsource:iporhost}: )?(?::?\*)?{device_timestamp:ciscotime}: "
    r"(?:%{facility:iosfacility}-{severity:iosseverity}-{mnemonic:iosmnemonic}: |{program:ciscoprog}: )?"
    r"{device_message:rest}"
)


def _from_header(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            **decode_pri(F.col("syslog_pri")),
            "asa_id": F.substring_index("ciscotag", "-", -1).try_cast("bigint"),
            "event_ts": F.coalesce(device_time(F.col("timestamp"), F.col("received_at")), "received_at"),
            "source_host": F.coalesce("sysloghost", "host"),
            "msg": F.col("message"),
        }
    )


def parse_asa_header(df: DataFrame) -> DataFrame:
    """Priority, time, host and message tag; event time from the header."""
    return _from_header(parse(df, HEADER, ok="header", longs=["syslog_pri"]))


def parse_asa(df: DataFrame) -> DataFrame:
    """Header and body of all 23 families into one set of columns.

    One regex reads the header and the family: the message id leads each
    alternative, so a row fails 22 of them on the id alone.  Only lines
    without a known id, or whose body does not fit it, go on to a second regex that
    tries the families in order.  All families share one column layout, so
    one ``split`` serves them all.  ``asa_family`` is the family of the id.
    """
    line = clean(F.col("message"))
    layout = ["syslog_pri", "timestamp", "sysloghost", "_level", "_id", "_other", *BODY]
    at = {n: i for i, n in enumerate(layout, 1)}
    df = once(df, "_parts", F.split(rewrite(line, [_BY_ID], layout), SEP))
    unknown = f"{part('_parts', at['_id'])} IS NULL"
    df = once(df, "_any", F.when(F.expr(unknown), F.split(rewrite(line, _ANY, BODY), SEP)))
    cols = {n: part("_parts", i) for n, i in at.items() if not n.startswith("_")}
    cols["ciscotag"] = "{} || coalesce({}, {})".format(*[part("_parts", at[n]) for n in ("_level", "_id", "_other")])
    for i, name in enumerate(BODY, 1):
        cols[name] = f"coalesce({cols[name]}, {part('_any', i)})"
    cols["header"] = f"coalesce(size(_parts) = {len(layout) + 1}, false)"
    cols["parsed"] = f"NOT ({unknown}) OR coalesce(size(_any) = {len(BODY) + 1}, false)"
    cols = typed(cols, ["syslog_pri", *LONGS])
    df = _from_header(df.withColumns(cols).drop("_parts", "_any"))
    names = {i: "_".join(map(str, ids)) for ids in FAMILIES for i in ids}
    return df.withColumns(
        {
            "asa_family": F.try_element_at(lookup(names), F.col("asa_id").cast("int")),
            "duration_s": seconds_of(F.col("duration")),
            "tags": failed(F.col("tags"), F.col("header") & F.col("parsed")),
        }
    )


def flow_fingerprint(df: DataFrame, key: str = "logstash") -> DataFrame:
    """A keyed hash of the flow's four-tuple, for firewall events with both addresses."""
    known = has_tag(F.col("tags"), "cisco-asa") & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    value = flow_hash(*[F.col(c) for c in ("src_ip", "dst_ip", "dst_port", "protocol")], key=key)
    return df.withColumn("fingerprint", F.when(known, value))


def top_flows(df: DataFrame, n: int = 10, key: str = "logstash") -> DataFrame:
    """The busiest flows; counted on the tuple, hashed only for the result."""
    flow = ["src_ip", "dst_ip", "dst_port", "protocol"]
    return (
        df.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
        .groupBy(*flow)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), *[F.asc_nulls_last(c) for c in flow])
        .limit(n)
        .withColumn("fingerprint", flow_hash(*[F.col(c) for c in flow], key=key))
    )


def parse_ios(df: DataFrame) -> DataFrame:
    """IOS device lines with facility, severity and mnemonic."""
    df = parse(df, IOS, longs=["counter", "severity"])
    code = F.concat(F.lit("%"), F.concat_ws("-", "facility", F.col("severity").cast("string"), "mnemonic"))
    return df.withColumn("program", F.when(F.col("facility").isNotNull(), code).otherwise(F.col("program")))
