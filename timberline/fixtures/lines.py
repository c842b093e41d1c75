"""Builders of raw channel tables from ``events``, ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.fixtures.shapes import Shapes, one_of, text
from timberline.functions.tags import no_tags
from timberline.session import spread, table

# Expressions that Spark and DuckDB read alike.
PRI = "((event_id % 24) * 8 + cast(floor(event_id / 24) as bigint) % 8)"
HOST = f"('host' || {text('user_id % 10')})"
USER = f"('user' || {text('user_id')})"
SRC_IP = f"('10.' || {text('user_id % 30')} || '.' || {text('user_id % 250')} || '.' || {text('event_id % 250')})"
DST_IP = f"('192.168.' || {text('event_id % 200')} || '.' || {text('user_id % 250')})"
PORT = "(1024 + event_id % 60000)"
OPTIONAL = "cast(floor(event_id / 23) as bigint) % 2 = 1"
KIND = "(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END)"

# DuckDB only: the times a builder writes.
DUCK_STAMP = "(strftime(ts, '%b') || ' ' || lpad(cast(day(ts) as varchar), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S'))"
DUCK_SECOND = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def stamp(ts: str = "ts") -> Column:
    """``MMM d HH:mm:ss`` with the day padded to two columns."""
    day = F.lpad(F.dayofmonth(ts).cast("string"), 2, " ")
    return F.concat_ws(" ", F.date_format(ts, "MMM"), day, F.date_format(ts, "HH:mm:ss"))


def raw_events(spark: SparkSession, folder: str, message: Column, source_type: str, host: Column | None = None) -> DataFrame:
    """Bronze columns with one line per event, next to the event's own columns."""
    return spread(table(spark, folder, "events")).select(
        F.lit(source_type).alias("type"),
        message.alias("message"),
        (host if host is not None else F.lit("relay")).alias("host"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("ingest_seq"),
        no_tags().alias("tags"),
    )


# --- system log ---------------------------------------------------------------
SYSLOG_BODY = Shapes(
    selector=KIND,
    optional=OPTIONAL,
    common={"user": USER, "ip": SRC_IP, "port": text(PORT), "id": text("event_id")},
    alternatives=[
        "Failed password for {user} from {ip} port {port} ssh2",
        "GET /page/{id} served",
        "Invalid user {user} from {ip}",
        "session opened for {user}",
        "order {id} accepted",
    ],
)
SYSLOG_TEXT = (
    f"(CASE {KIND} WHEN 0 THEN 'Failed password for ' || {USER} || ' from ' || {SRC_IP} || ' port ' || {text(PORT)} || ' ssh2' "
    f"WHEN 1 THEN 'GET /page/' || {text('event_id')} || ' served' WHEN 2 THEN 'Invalid user ' || {USER} || ' from ' || {SRC_IP} "
    f"WHEN 3 THEN 'session opened for ' || {USER} ELSE 'order ' || {text('event_id')} || ' accepted' END)"
)
PROGRAM = one_of(KIND, ["sshd", "httpd", "sshd", "sudo", "kernel"])
JUNK = "event_id % 50 = 0"
JUNK_TEXT = f"('line ' || {text('event_id')} || ' without priority')"


def syslog_lines(spark: SparkSession, folder: str) -> DataFrame:
    """BSD syslog; every 50th line is junk without a priority."""
    pid = F.when(F.expr(f"{KIND} = 4"), F.lit("")).otherwise(F.expr(f"'[' || {text('event_id + 1')} || ']'"))
    line = F.concat(
        F.expr(f"'<' || {text(PRI)} || '>'"), stamp(), F.lit(" "), F.expr(HOST), F.lit(" "), F.expr(PROGRAM), pid,
        F.lit(": "), SYSLOG_BODY.line(),
    )
    return raw_events(spark, folder, F.when(F.expr(JUNK), F.expr(JUNK_TEXT)).otherwise(line), "syslog")


LOGIN = Shapes(
    selector="(event_id % 4)",
    optional=OPTIONAL,
    common={
        "username": USER, "logname": USER, "ruser": USER, "user": USER, "src_ip": SRC_IP, "port": text(PORT),
        "pid": text("event_id + 1"), "uid": text("user_id"), "euid": text("user_id % 3"),
        "tty": f"('/dev/pts/' || {text('user_id % 9')})", "remote_host": f"('ws' || {text('user_id % 40')})",
    },
    alternatives=[
        "sshd[{pid}]: Failed password for invalid user {username} from {src_ip} port {port} ssh2",
        "sshd[{pid}]: Failed password for {username} from {src_ip} port {port} ssh2",
        "sshd[{pid}]: Accepted password for {username} from {src_ip} port {port} ssh2",
        "sudo: pam_unix(sudo:auth): authentication failure; logname={logname} uid={uid} euid={euid} tty={tty} "
        "ruser={ruser} rhost=[[{remote_host}]] user={user}",
    ],
)


def login_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.expr(f"'<' || {text(PRI)} || '>'"), stamp(), F.lit(" "), F.expr(HOST), F.lit(" "), LOGIN.line())
    return raw_events(spark, folder, line, "syslog")


RFC5424 = Shapes(
    selector="(event_id % 3)",
    optional=OPTIONAL,
    common={
        "syslog5424_pri": text(PRI), "syslog5424_host": HOST, "syslog5424_app": PROGRAM,
        "syslog5424_proc": text("event_id + 1"), "syslog5424_msgid": f"('ID' || {text('user_id')})",
        "syslog5424_sd": f"('[meta seq=' || chr(34) || {text('event_id')} || chr(34) || ']')",
        "syslog5424_msg": f"('event ' || {text('event_id')} || ' ' || event_type)", "ver": "'1'",
    },
    alternatives=[
        " {syslog5424_host} {syslog5424_app} {syslog5424_proc} {syslog5424_msgid} {syslog5424_sd} {syslog5424_msg}",
        " {syslog5424_host} {syslog5424_app} - - - {syslog5424_msg}",
        " - {syslog5424_app} - {syslog5424_msgid} - {syslog5424_msg}",
    ],
)


def rfc5424_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The time is absent (``-``) in every third line."""
    time = F.when(F.expr("event_id % 3 = 2"), F.lit("-")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.concat(F.expr(f"'<' || {text(PRI)} || '>1 '"), time, RFC5424.line())
    return raw_events(spark, folder, line, "syslog")


GENERIC = Shapes(
    selector="(event_id % 2)",
    optional=OPTIONAL,
    common={
        "facility": text("event_id % 24"), "priority": text("event_id % 8"), "logsource": HOST, "program": PROGRAM,
        "pid": text("event_id + 1"), "line_message": f"(event_type || ' ' || {text('event_id')})",
        "pam_caller": "(CASE WHEN event_id % 3 = 0 THEN 'su:session' ELSE 'sshd:session' END)",
        "pam_session_state": "(CASE WHEN user_id % 2 = 0 THEN 'opened' ELSE 'closed' END)", "username": USER,
        "pam_by": f"('(uid=' || {text('user_id')} || ')')", "pam_module": "'pam_unix'", "user": USER,
        "action": "(CASE WHEN event_id % 3 = 0 THEN 'CMD' ELSE 'END EDIT' END)",
    },
    alternatives=[
        " [[<{facility}.{priority}> ]]{logsource} {program}[{pid}]: {line_message}",
        " {logsource} {program}: {line_message}",
    ],
)
PAM = Shapes(
    "(event_id % 2)", OPTIONAL, GENERIC.common,
    [
        " {logsource} {program}[{pid}]: {pam_module}({pam_caller}): session {pam_session_state} for user {username}[[ by {pam_by}]]",
        " {logsource} {program}: {line_message}",
    ],
)
CRON = Shapes(
    "(event_id % 2)", OPTIONAL, GENERIC.common,
    [" {logsource} crond[{pid}]: ({user}) {action} ({line_message})", " {logsource} crond[{pid}]: ({user}) {action} ({line_message})"],
)


def generic_lines(spark: SparkSession, folder: str, shapes: Shapes = GENERIC) -> DataFrame:
    """Lines that start with a time; odd ones use ISO 8601."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = F.when(F.expr("event_id % 2 = 1"), iso).otherwise(stamp())
    return raw_events(spark, folder, F.concat(time, shapes.line()), "syslog")


def canary_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Signup events carry the monitoring test line."""
    body = F.expr(
        f"' ' || {HOST} || ' check: probe ' || {text('event_id')} || "
        "(CASE WHEN event_type = 'signup' THEN ' nagios log test' ELSE '' END)"
    )
    return raw_events(spark, folder, F.concat(stamp(), body), "syslog")


# --- firewalls ----------------------------------------------------------------
_IF = {
    "src_interface": one_of("(user_id % 2)", ["outside", "dmz"]),
    "dst_interface": one_of("(event_id % 2)", ["inside", "mgmt"]),
}
ASA_COMMON = {
    "src_ip": SRC_IP, "dst_ip": DST_IP, "src_port": text(PORT), "dst_port": one_of("(event_id % 3)", ["80", "443", "22"]),
    "protocol": "'TCP'", "action": "'Deny'", "direction": "'inbound'", "interface": "'outside'", **_IF,
    "src_fwuser": USER, "dst_fwuser": f"('d' || {USER})", "fwuser": USER, "user": USER,
    "icmp_type": text("event_id % 9"), "icmp_code": text("event_id % 4"), "tcp_flags": "'SYN ACK'",
    "policy_id": f"('acl' || {text('user_id % 7')})", "hashcode1": f"('0x' || {text('event_id')})", "hashcode2": "'0x0'",
    "reason": "'Failed to locate egress interface'", "hit_count": text("1 + event_id % 5"), "interval": "'300-second interval'",
    "connection_count": text("event_id % 900"), "connection_count_max": text("1000 + event_id"),
    "connection_id": text("event_id + 70000"), "src_mapped_ip": DST_IP, "src_mapped_port": text("event_id % 5000 + 1"),
    "dst_mapped_ip": SRC_IP, "dst_mapped_port": text("user_id + 1"),
    "duration": f"('0:' || lpad({text('event_id % 60')}, 2, '0') || ':' || lpad({text('user_id % 60')}, 2, '0'))",
    "bytes": text("event_id * 3"), "icmp_seq_num": text("event_id % 700"), "src_xlated_ip": DST_IP,
    "src_xlated_interface": "'inside'", "src_xlated_port": text("event_id % 6000"), "icmp_code_xlated": text("event_id % 6"),
    "xlate_type": one_of("(user_id % 2)", ["static", "dynamic"]), "err_protocol": "'icmp'", "err_src_interface": "'outside'",
    "err_src_ip": SRC_IP, "err_src_fwuser": USER, "err_dst_interface": "'inside'", "err_dst_ip": DST_IP, "err_dst_fwuser": USER,
    "err_icmp_type": text("event_id % 5"), "err_icmp_code": text("event_id % 3"), "orig_protocol": "'udp'",
    "orig_src_ip": DST_IP, "orig_src_port": text("event_id % 999"), "orig_src_fwuser": USER, "orig_dst_ip": SRC_IP,
    "orig_dst_port": "'53'", "orig_dst_fwuser": USER, "spi": f"('0x' || {text('user_id')})", "seq_num": f"('0x' || {text('event_id')})",
    "tunnel_type": "'LAN-to-LAN'", "group": f"('grp' || {text('user_id % 5')})", "is_remote_natted": one_of("(user_id % 2)", ["is", "is NOT"]),
    "is_local_natted": one_of("(event_id % 2)", ["is NOT", "is"]), "drop_type": "'Scanning'", "drop_rate_id": "'rate-1'",
    "drop_rate_current_burst": text("event_id % 11"), "drop_rate_max_burst": "'10'", "drop_rate_current_avg": text("event_id % 13"),
    "drop_rate_max_avg": "'5'", "drop_total_count": text("event_id * 2"),
}
_UDP, _ICMP = {"protocol": "'UDP'"}, {"protocol": "'icmp'"}
# One line per family, in message id order; the first id of each family is written.
ASA_IDS = [
    106001, 106006, 106014, 106015, 106021, 106023, 106100, 110002, 302010, 302013, 302020, 305011,
    313001, 313005, 402117, 402119, 419001, 419002, 500004, 602303, 710001, 713172, 733100,
]
ASA = Shapes(
    selector="(event_id % 23)",
    optional=OPTIONAL,
    common=ASA_COMMON,
    alternatives=[
        ("{direction} {protocol} connection {action} from {src_ip}/{src_port} to {dst_ip}/{dst_port} flags {tcp_flags} on interface {interface}",
         {"direction": "'Inbound'", "action": "'denied'"}),
        ("{action} {direction} {protocol} from {src_ip}/{src_port}[[({src_fwuser})]] to {dst_ip}/{dst_port}[[({dst_fwuser})]] due to {reason}",
         {**_UDP, "reason": "'DNS Query'"}),
        ("{action} {direction} {protocol} src {src_interface}:{src_ip}[[({src_fwuser})]] dst {dst_interface}:{dst_ip}[[({dst_fwuser})]] (type {icmp_type}, code {icmp_code})", _ICMP),
        ("{action} {protocol} ({policy_id}) from {src_ip}/{src_port} to {dst_ip}/{dst_port} flags {tcp_flags}  on interface {interface}",
         {"policy_id": "'no connection'"}),
        ("{action} {protocol} reverse path check from {src_ip} to {dst_ip} on interface {interface}", _UDP),
        "{action} {protocol} src {src_interface}:{src_ip}[[/{src_port}]] dst {dst_interface}:{dst_ip}[[/{dst_port}]] by access-group {policy_id} [{hashcode1}, {hashcode2}]",
        ("access-list {policy_id} {action} {protocol} {src_interface}/{src_ip}({src_port})[[({src_fwuser})]] -> {dst_interface}/{dst_ip}({dst_port})[[({dst_fwuser})]] hit-cnt {hit_count} {interval} [{hashcode1}, {hashcode2}]",
         {"action": "'permitted'"}),
        ("{reason} for {protocol} from {src_interface}:{src_ip}/{src_port} to {dst_ip}/{dst_port}", _UDP),
        "{connection_count} in use, {connection_count_max} most used",
        ("{action}[[ {direction}]] {protocol} connection {connection_id} for {src_interface}:{src_ip}/{src_port}[[ ({src_mapped_ip}/{src_mapped_port})]][[({src_fwuser})]] to {dst_interface}:{dst_ip}/{dst_port}[[ ({dst_mapped_ip}/{dst_mapped_port})]][[({dst_fwuser})]][[ duration {duration} bytes {bytes}]][[ {reason}]][[ ({user})]]",
         {"action": one_of("(user_id % 2)", ["Built", "Teardown"]), "reason": "'TCP FINs'"}),
        ("{action}[[ {direction}]] {protocol} connection for faddr {dst_ip}/{icmp_seq_num}[[({fwuser})]] gaddr {src_xlated_ip}/{icmp_code_xlated} laddr {src_ip}/{icmp_code}[[ ({user})]]",
         {"action": "'Teardown'", "protocol": "'ICMP'"}),
        ("{action} {xlate_type} {protocol} translation from {src_interface}:{src_ip}[[/{src_port}]][[({src_fwuser})]] to {src_xlated_interface}:{src_xlated_ip}/{src_xlated_port}", {"action": "'Built'"}),
        ("{action} {protocol} type={icmp_type}, code={icmp_code} from {src_ip} on interface {interface}[[ to {dst_ip}]]", {"action": "'Denied'", "protocol": "'ICMP'"}),
        ("{reason} for {protocol} error message: {err_protocol} src {err_src_interface}:{err_src_ip}[[({err_src_fwuser})]] dst {err_dst_interface}:{err_dst_ip}[[({err_dst_fwuser})]] (type {err_icmp_type}, code {err_icmp_code}) on {interface} interface.  Original IP payload: {orig_protocol} src {orig_src_ip}/{orig_src_port}[[({orig_src_fwuser})]] dst {orig_dst_ip}/{orig_dst_port}[[({orig_dst_fwuser})]]",
         {"reason": "'No matching connection'", "protocol": "'ICMP'"}),
        ("{protocol}: Received a non-IPSec packet (protocol= {orig_protocol}) from {src_ip} to {dst_ip}", {"protocol": "'IPSEC'"}),
        ("{protocol}: Received an {orig_protocol} packet (SPI= {spi}, sequence number= {seq_num}) from {src_ip} (user= {user}) to {dst_ip} that failed anti-replay checking",
         {"protocol": "'IPSEC'", "orig_protocol": "'ESP'"}),
        ("{action} {protocol} packet from {src_interface}:{src_ip}/{src_port} to {dst_interface}:{dst_ip}/{dst_port}, reason: {reason}",
         {"action": "'Dropping'", "reason": "'MSS exceeded, MSS 1380, data 1460'"}),
        ("{reason} from {src_interface}:{src_ip}/{src_port} to {dst_interface}:{dst_ip}/{dst_port} with different initial sequence number", {"reason": "'Duplicate TCP SYN'"}),
        ("{reason} for protocol={protocol}, from {src_ip}/{src_port} to {dst_ip}/{dst_port}", {**_UDP, "reason": "'Invalid transport field'"}),
        ("{protocol}: An {direction} {tunnel_type} SA (SPI= {spi}) between {src_ip} and {dst_ip} (user= {user}) has been {action}",
         {"protocol": "'IPSEC'", "direction": "'outbound'", "action": "'created'"}),
        ("{protocol} access {action} from {src_ip}/{src_port} to {dst_interface}:{dst_ip}/{dst_port}",
         {"action": one_of("(user_id % 2)", ["permitted", "denied by ACL"])}),
        "Group = {group}, IP = {src_ip}, Automatic NAT Detection Status:     Remote end   {is_remote_natted}   behind a NAT device     This   end   {is_local_natted}   behind a NAT device",
        "[ {drop_type}] drop {drop_rate_id} exceeded. Current burst rate is {drop_rate_current_burst} per second, max configured rate is {drop_rate_max_burst}; Current average rate is {drop_rate_current_avg} per second, max configured rate is {drop_rate_max_avg}; Cumulative total count is {drop_total_count}",
    ],
)
ASA_ID = "(CASE event_id % 23 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(ASA_IDS)) + " END)"
ASA_LEVEL = "(1 + event_id % 7)"
ASA_PRI = "(160 + event_id % 8)"


def asa_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every family; the year and the host are written on half of the lines."""
    day = F.lpad(F.dayofmonth("ts").cast("string"), 2, " ")
    year = F.when(F.expr(OPTIONAL), F.date_format("ts", " yyyy")).otherwise(F.lit(""))
    host = F.when(F.expr(OPTIONAL), F.expr(f"' ' || {HOST}")).otherwise(F.lit(""))
    head = F.concat(
        F.expr(f"'<' || {text(ASA_PRI)} || '>'"), F.date_format("ts", "MMM "), day, year, F.date_format("ts", " HH:mm:ss"), host,
        F.expr(f"': %ASA-' || {text(ASA_LEVEL)} || '-' || {text(ASA_ID)} || ': '"),
    )
    return raw_events(spark, folder, F.concat(head, ASA.line()), "firewall").withColumn("tags", F.array(F.lit("cisco-asa")))


IOS = Shapes(
    selector="(event_id % 3)",
    optional=OPTIONAL,
    common={
        "counter": text("event_id + 1"), "logsource": HOST, "facility": one_of("(user_id % 3)", ["SYS", "LINK", "SEC_LOGIN"]),
        "severity": text("event_id % 8"), "mnemonic": one_of("(user_id % 2)", ["CONFIG_I", "UPDOWN"]),
        "device_message": f"('change ' || {text('event_id')})",
    },
    alternatives=[": %{facility}-{severity}-{mnemonic}: {device_message}"] * 2 + [": {device_message}"],
)


def ios_lines(spark: SparkSession, folder: str) -> DataFrame:
    source = F.when(F.expr(OPTIONAL), F.expr(f"{HOST} || ': '")).otherwise(F.lit(""))
    line = F.concat(F.expr(f"{text('event_id + 1')} || ': '"), source, F.lit("*"), stamp(), IOS.line())
    return raw_events(spark, folder, line, "syslog")


NETSCREEN = Shapes(
    selector="(event_id % 1)",
    optional=OPTIONAL,
    common={
        "device": HOST, "device_id": f"('fw' || {text('user_id % 10')})", "duration": text("event_id % 500"),
        "policy_id": text("user_id"), "service": one_of("(event_id % 3)", ["http", "dns", "tcp/port:22"]), "proto": one_of("(event_id % 2)", ["6", "17"]),
        "src_zone": "'Untrust'", "dst_zone": "'Trust'", "action": one_of("(user_id % 2)", ["Permit", "Deny"]),
        "sent": text("event_id * 7"), "rcvd": text("event_id * 5"), "src_ip": SRC_IP, "dst_ip": DST_IP,
        "src_port": text(PORT), "dst_port": one_of("(event_id % 3)", ["80", "53", "22"]), "src_xlated_ip": DST_IP,
        "src_xlated_port": text("event_id % 4000"), "dst_xlated_ip": SRC_IP, "dst_xlated_port": text("user_id"),
        "session_id": text("event_id + 1"), "reason": one_of("(event_id % 2)", ["Close - TCP FIN", "Close - AGE OUT"]),
    },
    alternatives=[
        " {device} {device_id}: NetScreen device_id={device_id}  [Root]system-notification-00257(traffic): start_time=",
    ],
)
NETSCREEN_TAIL = Shapes(
    "(event_id % 1)", OPTIONAL, NETSCREEN.common,
    [
        " duration={duration} policy_id={policy_id} service={service} proto={proto} src zone={src_zone} dst zone={dst_zone} "
        "action={action} sent={sent} rcvd={rcvd} src={src_ip} dst={dst_ip} src_port={src_port} dst_port={dst_port} "
        "src-xlated ip={src_xlated_ip} port={src_xlated_port} dst-xlated ip={dst_xlated_ip} port={dst_xlated_port} "
        "session_id={session_id} reason={reason}",
    ],
)


def netscreen_lines(spark: SparkSession, folder: str) -> DataFrame:
    start = F.date_format("ts", "\"yyyy-MM-dd HH:mm:ss\"")
    return raw_events(spark, folder, F.concat(stamp(), NETSCREEN.line(), start, NETSCREEN_TAIL.line()), "firewall")


IPTABLES = Shapes(
    selector="(event_id % 3)",
    optional=OPTIONAL,
    common={
        "iptables_action": one_of(KIND, ["DROP", "ACCEPT", "REJECT", "DROP", "ACCEPT"]), "src_ip": SRC_IP, "dst_ip": DST_IP,
        "src_port": text(PORT), "dst_port": one_of("(event_id % 3)", ["80", "443", "22"]), "proto": "'TCP'", "id": text("event_id"),
    },
    alternatives=[
        " IPTables-{iptables_action}: IN=eth0 OUT= SRC={src_ip} DST={dst_ip} LEN=60 TOS=0x00 PREC=0x00 TTL=63 ID={id} DF PROTO={proto} SPT={src_port} DPT={dst_port} WINDOW=14600 SYN",
        (" IPTables-{iptables_action}: IN=eth0 OUT= SRC={src_ip} DST={dst_ip} LEN=84 ID={id} PROTO={proto} TYPE=8 CODE=0", {"proto": "'ICMP'"}),
        " kernel: device eth0 up {id}",
    ],
)


def iptables_lines(spark: SparkSession, folder: str) -> DataFrame:
    return raw_events(spark, folder, F.concat(stamp(), F.expr(f"' ' || {HOST}"), IPTABLES.line()), "syslog")


PAN = Shapes(
    "(event_id % 2)", OPTIONAL, {"nas_port": f"('eth' || {text('user_id')})", "id": text("event_id")},
    [" {nas_port},{id},TRAFFIC,end", " {nas_port},{id},THREAT,url"],
)


def pan_lines(spark: SparkSession, folder: str) -> DataFrame:
    return raw_events(spark, folder, F.concat(stamp(), PAN.line()), "firewall")


# --- hypervisors --------------------------------------------------------------
_VM_BODY = {
    "message_thread_id": f"('7F' || {text('user_id')})", "syslog_level": one_of("(user_id % 3)", ["info", "verbose", "warning"]),
    "message_service": "'Vimsvc.ha-eventmgr'", "message_opID": f"('opID=task-' || {text('event_id')})",
    "message_service_info": "'UserOps'", "syslog_message": f"('Event ' || {text('event_id')} || ' : ' || event_type)",
    "program": one_of("(user_id % 2)", ["Hostd", "vpxa"]), "pid": text("event_id + 1"), "syslog_pri": text(PRI), "syslog_hostname": HOST,
}
_VM_FORMS = [
    "[{message_thread_id} {syslog_level} '{message_service}' {message_opID}] [{message_service_info}] {syslog_message}",
    "[{message_thread_id} {syslog_level} '{message_service}' {message_opID}] {syslog_message}",
    "{syslog_message}",
]
VM = Shapes("(event_id % 3)", OPTIONAL, _VM_BODY, _VM_FORMS)


def esxi_lines(spark: SparkSession, folder: str) -> DataFrame:
    pid = F.when(F.expr(OPTIONAL), F.expr(f"'[' || {text('event_id + 1')} || ']'")).otherwise(F.lit(""))
    line = F.concat(
        F.expr(f"'<' || {text(PRI)} || '>'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.expr(f"' ' || {HOST} || ' '"),
        F.expr(_VM_BODY["program"]), pid, F.lit(": "), VM.line(),
    )
    return raw_events(spark, folder, line, "VMware")


def vcenter_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(
        F.expr(f"'<' || {text(PRI)} || '>'"), stamp(), F.expr(f"' ' || {HOST} || ' '"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z '"), VM.line(),
    )
    return raw_events(spark, folder, line, "vCenter")


STORAGE = Shapes(
    selector="(event_id % 4)",
    optional=OPTIONAL,
    common={
        "device_naa": f"('6006' || {text('user_id')})", "device_status": "'deteriorated'",
        "datastore_latency_from": text("event_id % 900 + 1"), "datastore_latency_to": text("event_id + 5000"),
        "device_access": "'Lost access'", "device_id": f"('4f2a-' || {text('user_id')})", "datastore": f"('(ds' || {text('event_id % 30')} || ')')",
        "vmware_warning_msg": f"('NFS: heap low ' || {text('event_id')})",
    },
    alternatives=[
        "vmkernel: Device naa.{device_naa} performance has {device_status}. I/O latency increased from average value of {datastore_latency_from} microseconds to {datastore_latency_to} microseconds.",
        ("vmkernel: Device naa.{device_naa} performance has {device_status}. I/O latency reduced from {datastore_latency_from} microseconds to {datastore_latency_to} microseconds.", {"device_status": "'improved'"}),
        "Hostd: [info] Event : {device_access} to volume {device_id} {datastore} due to connectivity issues. Recovery attempt is in progress.",
        "vmkernel: WARNING: {vmware_warning_msg}",
    ],
)


def storage_lines(spark: SparkSession, folder: str) -> DataFrame:
    return raw_events(spark, folder, STORAGE.line(), "VMware")


# --- monitoring, databases, Windows -------------------------------------------
_N = {
    "nagios_hostname": HOST, "nagios_service": one_of("(event_id % 2)", ["Disk /var", "Load"]), "nagios_state": one_of("(user_id % 3)", ["OK", "WARNING", "CRITICAL"]),
    "nagios_statetype": "'HARD'", "nagios_statecode": "'1'", "nagios_message": f"('value ' || {text('event_id')} || '; limit 5')",
    "nagios_notifyname": USER, "nagios_contact": "'notify-by-email'", "nagios_statelevel": "'SOFT'", "nagios_attempt": text("event_id % 4 + 1"),
    "nagios_comment": f"('note ' || {text('event_id')})", "nagios_event_handler_name": "'restart-httpd'",
    "nagios_unknown1": text("event_id % 2"), "nagios_unknown2": text("user_id % 2"), "nagios_check_result": f"('result ' || {text('event_id')})",
    "nagios_start_time": text("1700000000 + event_id"), "nagios_end_time": text("1700003600 + event_id"), "nagios_fixed": "'1'",
    "nagios_trigger_id": "'0'", "nagios_duration": "'3600'", "nagios_author": USER, "nagios_comment_text": "'patching'",
}
_H, _S, _ST = "{nagios_hostname}", "{nagios_service}", "{nagios_state}"


def _t(kind: str, rest: str) -> tuple[str, dict[str, str]]:
    return "{nagios_type}: " + rest, {"nagios_type": f"'{kind}'"}


def _c(command: str, rest: str) -> tuple[str, dict[str, str]]:
    return "{nagios_type}: {nagios_command};" + rest, {"nagios_type": "'EXTERNAL COMMAND'", "nagios_command": f"'{command}'"}


NAGIOS = Shapes(
    selector="(event_id % 23)",
    optional=OPTIONAL,
    common=_N,
    alternatives=[
        "Warning: {nagios_message}",
        _t("CURRENT SERVICE STATE", f"{_H};{_S};{_ST};{{nagios_statetype}};{{nagios_statecode}};{{nagios_message}}"),
        _t("CURRENT HOST STATE", f"{_H};{_ST};{{nagios_statetype}};{{nagios_statecode}};{{nagios_message}}"),
        _t("SERVICE NOTIFICATION", f"{{nagios_notifyname}};{_H};{_S};{_ST};{{nagios_contact}};{{nagios_message}}"),
        _t("HOST NOTIFICATION", f"{{nagios_notifyname}};{_H};{_ST};{{nagios_contact}};{{nagios_message}}"),
        _t("SERVICE ALERT", f"{_H};{_S};{_ST};{{nagios_statelevel}};{{nagios_attempt}};{{nagios_message}}"),
        _t("HOST ALERT", f"{_H};{_ST};{{nagios_statelevel}};{{nagios_attempt}};{{nagios_message}}"),
        _t("SERVICE FLAPPING ALERT", f"{_H};{_S};{_ST};{{nagios_message}}"),
        _t("HOST FLAPPING ALERT", f"{_H};{_ST};{{nagios_message}}"),
        _t("SERVICE DOWNTIME ALERT", f"{_H};{_S};{_ST};{{nagios_comment}}"),
        _t("HOST DOWNTIME ALERT", f"{_H};{_ST};{{nagios_comment}}"),
        _t("PASSIVE SERVICE CHECK", f"{_H};{_S};{_ST};{{nagios_comment}}"),
        _t("PASSIVE HOST CHECK", f"{_H};{_ST};{{nagios_comment}}"),
        _t("SERVICE EVENT HANDLER", f"{_H};{_S};{_ST};{{nagios_statelevel}};{{nagios_event_handler_name}}"),
        _t("HOST EVENT HANDLER", f"{_H};{_ST};{{nagios_statelevel}};{{nagios_event_handler_name}}"),
        _t("TIMEPERIOD TRANSITION", f"{_S};{{nagios_unknown1}};{{nagios_unknown2}};"),
        _c("DISABLE_SVC_CHECK", f"{_H};{_S}"),
        _c("DISABLE_HOST_CHECK", _H),
        _c("ENABLE_SVC_CHECK", f"{_H};{_S}"),
        _c("ENABLE_HOST_CHECK", _H),
        _c("PROCESS_SERVICE_CHECK_RESULT", f"{_H};{_S};{_ST};{{nagios_check_result}}"),
        _c("PROCESS_HOST_CHECK_RESULT", f"{_H};{_ST};{{nagios_check_result}}"),
        _c("SCHEDULE_HOST_DOWNTIME", f"{_H};{{nagios_start_time}};{{nagios_end_time}};{{nagios_fixed}};{{nagios_trigger_id}};{{nagios_duration}};{{nagios_author}};{{nagios_comment}}"),
    ],
)


def nagios_lines(spark: SparkSession, folder: str) -> DataFrame:
    epoch = F.unix_seconds("ts").cast("string")
    return raw_events(spark, folder, F.concat(F.lit("["), epoch, F.lit("] "), NAGIOS.line()), "syslog")


def redis_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(
        F.expr(f"'[' || {text('event_id + 1')} || '] '"), F.date_format("ts", "dd MMM HH:mm:ss"),
        F.expr(f"(CASE WHEN event_id % 4 = 3 THEN ' # ' ELSE ' * ' END) || 'save ' || {text('user_id')}"),
    )
    return raw_events(spark, folder, line, "syslog")


def postgres_lines(spark: SparkSession, folder: str) -> DataFrame:
    body = F.expr(f"' UTC ' || {USER} || ' c' || {text('event_id')} || '.' || {text('user_id')} || ' ' || {text('event_id + 1')}")
    return raw_events(spark, folder, F.concat(F.date_format("ts", "MM/dd/yyyy HH:mm:ss"), body), "syslog")


EVENT_IDS = "(CASE event_type WHEN 'error' THEN 4740 WHEN 'click' THEN 4738 WHEN 'view' THEN 4624 WHEN 'signup' THEN 4625 ELSE 4776 END)"
SEVERITY_NAME = one_of("(event_id % 3)", ["INFO", "WARNING", "ERROR"])
CHANNEL = one_of("(user_id % 3)", ["Security", "System", "Application"])
CORRUPT = "event_id % 50 = 7"


def eventlog_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON records; two in a hundred are cut short and not valid."""
    parts = {
        "EventType": "'AUDIT'", "FileName": "'SEC.EVTX'", "Hostname": f"upper({HOST})", "Severity": SEVERITY_NAME,
        "SeverityValue": "event_id % 5", "EventReceivedTime": "unix_seconds(ts)", "Message": f"'account ' || {USER}",
        "Channel": CHANNEL, "SourceName": "'Auditing'", "SourceModuleName": "'in'", "SourceModuleType": "'im_msvistalog'",
        "Category": "event_type", "EventID": EVENT_IDS, "RecordNumber": "event_id", "ProcessID": "user_id + 4",
        "SubjectUserName": f"('user' || {text('user_id % 20')})", "TargetUserName": f"('user' || {text('event_id % 20')})",
        "UserID": f"('S-1-5-' || {text('user_id % 12')})",
        "errorCode": "(CASE WHEN event_type = 'error' THEN '0x18' END)", "flat_message": f"'flat ' || {text('event_id')}",
        "Task": "event_id",
    }
    json = F.to_json(F.struct(*[F.expr(f"{sql}").alias(name) for name, sql in parts.items()]))
    cut = F.when(F.expr(CORRUPT), F.substring(json, 1, 40)).otherwise(json)
    return raw_events(spark, folder, cut, "eventlog").withColumn("tags", F.array(F.lit("WindowsEventLog")))


# --- web ----------------------------------------------------------------------
PAGE_STATUS = "(CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 301 END)"
PAGE_IP = f"('10.' || {text('page_id % 30')} || '.' || {text('page_id % 250')} || '.' || {text('page_id % 200')})"
PAGE_PATH = "('/p/' || cast(page_id as string) || '/' || cast(length(url) as string))"
PAGE_TIME = "1704067200 + page_id * 61"


def _page_events(spark: SparkSession, folder: str, message: Column, source_type: str) -> DataFrame:
    return spread(table(spark, folder, "pages")).select(
        F.lit(source_type).alias("type"), message.alias("message"), F.expr("'web' || cast(page_id % 5 as string)").alias("host"),
        F.timestamp_seconds(F.expr(PAGE_TIME)).alias("received_at"), F.col("page_id").alias("ingest_seq"), no_tags().alias("tags"),
    )


def access_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Combined log; ``-`` for no bytes on every fifth line, a bad request line on every ninth."""
    at = F.date_format(F.timestamp_seconds(F.expr(PAGE_TIME)), "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(
        F.expr(f"{PAGE_IP} || ' - ' || (CASE WHEN page_id % 3 = 0 THEN 'admin' ELSE '-' END) || ' ['"), at, F.lit(' +0000] "'),
        F.expr(f"(CASE WHEN page_id % 9 = 4 THEN 'bad request line' ELSE (CASE WHEN page_id % 2 = 0 THEN 'GET ' ELSE 'POST ' END) || {PAGE_PATH} || ' HTTP/1.1' END)"),
        F.expr(f"chr(34) || ' ' || cast({PAGE_STATUS} as string) || ' ' || (CASE WHEN page_id % 5 = 0 THEN '-' ELSE cast(length(html) as string) END) || ' '"),
        F.expr("chr(34) || url || chr(34) || ' ' || chr(34) || 'Mozilla/5.0 (X11; rv:' || cast(page_id % 90 as string) || '.0)' || chr(34)"),
    )
    return _page_events(spark, folder, line, "apache")


def iis_lines(spark: SparkSession, folder: str) -> DataFrame:
    """W3C lines; every tenth one is a ``#`` header."""
    at = F.date_format(F.timestamp_seconds(F.expr(PAGE_TIME)), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(
        at,
        F.expr(
            f"' web' || cast(page_id % 5 as string) || '.corp ' || (CASE WHEN page_id % 2 = 0 THEN 'GET ' ELSE 'POST ' END) || {PAGE_PATH} || ' ' || "
            "(CASE WHEN page_id % 3 = 0 THEN '-' ELSE 'q=' || cast(page_id as string) END) || ' 443 ' || "
            f"(CASE WHEN page_id % 4 = 0 THEN '-' ELSE 'CORP/u' || cast(page_id as string) END) || ' ' || {PAGE_IP} || ' Mozilla/5.0+(X11) ' || "
            f"cast({PAGE_STATUS} as string) || ' 0 ' || cast(page_id % 7 as string) || ' ' || cast(page_id * 3 as string)"
        ),
    )
    return _page_events(spark, folder, F.when(F.expr("page_id % 10 = 9"), F.lit("#Fields: date time")).otherwise(line), "iis")


# --- texts --------------------------------------------------------------------
def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's lines as one source; lines after the first are ``-->`` continuations
    except every third, which starts a new event."""
    docs = table(spark, folder, "documents")
    lines = docs.select(F.col("doc_id"), F.col("source"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    message = F.when((F.col("pos") % 3) == 0, F.col("line")).otherwise(F.concat(F.lit("--> "), F.col("line")))
    return lines.select(
        F.lit("VMware").alias("type"), message.alias("message"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("host"),
        F.col("pos").cast("bigint").alias("ingest_seq"),
    )


# --- dimensions ---------------------------------------------------------------
def ip_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One /16 per nation (10.n.0.0); the city is blank for every third."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    n = F.col("n_nationkey")
    geo = F.struct(
        F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("City "), n.cast("string"))).alias("city_name"),
        F.substring("r_name", 1, 2).alias("continent_code"),
        F.concat(F.lit("C"), n.cast("string")).alias("country_code2"),
        F.concat(F.lit("CC"), n.cast("string")).alias("country_code3"),
        F.col("n_name").alias("country_name"),
        (n * 7 - 90).cast("double").alias("latitude"),
        (n * 11 - 130).cast("double").alias("longitude"),
        F.lit("").alias("postal_code"),
        F.col("r_name").alias("region_name"),
        F.lit("UTC").alias("time_zone"),
    )
    start = (F.lit(10).cast("bigint") * 256 + n) * 65536
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        start.alias("start_ip"), (start + 65535).alias("end_ip"), geo.alias("geoip")
    )


def host_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as hosts: host<key> -> 172.16.x.y, only even keys."""
    s = table(spark, folder, "supplier")
    return s.select(
        F.expr("'host' || cast(s_suppkey * 2 as string)").alias("hostname"),
        F.expr("'172.16.' || cast(cast(floor(s_suppkey / 250) as bigint) as string) || '.' || cast(s_suppkey % 250 as string)").alias("ip"),
    )
