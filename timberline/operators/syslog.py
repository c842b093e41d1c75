"""System log lines: BSD, RFC 5424, generic, PAM, cron; logins; alert canary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import parse
from timberline.functions.grammar import line_pattern, register_pattern
from timberline.functions.scalar import decode_pri, device_time
from timberline.functions.tags import add_tags, failed, no_tags

BSD = [
    line_pattern(
        r"<{syslog_pri:pri}>{syslog_timestamp:syslogtime} "
        r"{syslog_hostname:iporhost} {syslog_program:data}(?:\[{syslog_pid:posint}\])?: {syslog_message:rest}"
    ),
    line_pattern(r"<{syslog_pri:pri}>{:space}{message_remainder:rest}"),
]

# RFC 5424: PRI VERSION SP TIMESTAMP SP HOSTNAME SP APP-NAME SP PROCID SP MSGID SP STRUCTURED-DATA [SP MSG];
# a hyphen is no value.
RFC5424 = line_pattern(
    r"<{syslog5424_pri:pri}>{syslog5424_ver:posint} "
    + " ".join(
        f"(?:-|{{syslog5424_{name}:{kind}}})"
        for name, kind in [
            ("ts", "isotime"), ("host", "printable"), ("app", "printable"),
            ("proc", "printable"), ("msgid", "printable"), ("sd", "sdelement"),
        ]
    )
    + r"(?: {syslog5424_msg:all})?",
    at_start=True,
)

_BASE = (
    r"(?:{timestamp:syslogtime}|{timestamp8601:isotime}) (?:<{facility:nonnegint}.{priority:nonnegint}> )?"
    r"{logsource:iporhost} {program:prog}(?:\[{pid:posint}\])?:"
)
GENERIC = line_pattern(_BASE + r" {line_message:rest}")
PAM = line_pattern(
    _BASE + r" {pam_module:word}\({pam_caller:data}\): session {pam_session_state:word} "
    r"for user {username:username}(?: by {pam_by:rest})?"
)
CRON = line_pattern(_BASE + r" \({user:username}\) {action:cronaction} \({line_message:data}\)")

register_pattern("sshoutcome", "(?:Failed password for invalid user|Failed password for|Accepted password for)")
register_pattern("sudooutcome", "authentication failure")
_LOGIN = r"{timestamp:syslogtime} {host_target:hostname} "
LOGINS = [
    line_pattern(
        _LOGIN + r"sshd\[{:num}\]: {login_outcome:sshoutcome} {username:username} from {src_ip:ip} port {port:num} ssh2"
    ),
    line_pattern(
        _LOGIN + r"sudo: pam_unix\(sudo:auth\): {login_outcome:sudooutcome}; "
        r"logname={logname:username} uid={uid:num} euid={euid:num} tty={tty:tty} ruser={ruser:username} "
        r"rhost=(?:{remote_host:hostname}|\s*) user={user:username}"
    ),
]
# Outcome in the line -> tag.  The spelling of the third tag is
# part of the output contract.
LOGIN_TAGS = {
    "Failed password for invalid user": "ssh_brute_force_attack",
    "Failed password for": "ssh_failed_login",
    "Accepted password for": "ssh_sucessful_login",
    "authentication failure": "sudo_auth_failure",
}

#: Words that only login lines have; the others do not go through the patterns.
LOGIN_WORDS = ["sshd[", "sudo: pam_unix(sudo:auth): "]

CANARY_TAG = "nagios_check_syslog_test"
CANARY = line_pattern(_BASE + r" {line_message:rest} nagios log test")


def parse_syslog(df: DataFrame) -> DataFrame:
    """BSD lines into fields, priority labels, event time and source host.

    A line that only carries a priority keeps it, with the rest in
    ``message_remainder``, and is tagged as a parse failure.
    """
    df = parse(df.withColumn("syslog_raw_message", F.col("message")), BSD, ok="_any", longs=["syslog_pri"])
    ok = F.col("syslog_hostname").isNotNull()
    behind = F.regexp_extract("message", r"<[0-9]{1,3}>\s*(.*)", 1)
    df = df.withColumns(
        {
            **decode_pri(F.col("syslog_pri")),
            "event_ts": F.coalesce(device_time(F.col("syslog_timestamp"), F.col("received_at")), "received_at"),
            "message_remainder": F.when(ok, behind).otherwise(F.col("message_remainder")),
            "received_from": F.col("host"),
            "source_host": F.coalesce("syslog_hostname", "host"),
            "msg": F.when(ok, F.coalesce("syslog_message", F.lit(""))).otherwise(F.col("message")),
            "tags": failed(F.col("tags"), ok),
        }
    )
    return df.withColumn("host", F.col("source_host")).drop("_any")


def parse_rfc5424(df: DataFrame) -> DataFrame:
    return parse(df, RFC5424, longs=["syslog5424_pri", "syslog5424_ver"])


def parse_generic(df: DataFrame) -> DataFrame:
    return parse(df, GENERIC, longs=["facility", "priority", "pid"])


def parse_pam(df: DataFrame) -> DataFrame:
    return parse(df, PAM, longs=["pid"])


def parse_cron(df: DataFrame) -> DataFrame:
    return parse(df, CRON, longs=["pid"])


def parse_logins(df: DataFrame) -> DataFrame:
    """Login fields and one tag per line that is a login event."""
    some = reduce(Column.__or__, [F.col("message").contains(words) for words in LOGIN_WORDS])
    df = parse(df, LOGINS, ok="login", longs=["port", "uid", "euid"], when=some)
    tag = F.lit(None).cast("string")
    for outcome, name in LOGIN_TAGS.items():
        tag = F.when(F.col("login_outcome") == outcome, F.lit(name)).otherwise(tag)
    df = df.withColumn("login_tag", tag).drop("login_outcome")
    found = F.when(F.col("login_tag").isNotNull(), F.array("login_tag")).otherwise(no_tags())
    return df.withColumn("tags", F.array_union(F.coalesce("tags", no_tags()), found))


def find_canary(df: DataFrame) -> DataFrame:
    """Mark the monitoring test line with its tag and service name."""
    df = parse(df, CANARY, ok="canary", when=F.col("message").contains("nagios log test"))
    return df.withColumns(
        {
            "tags": add_tags(F.col("tags"), CANARY_TAG, when=F.col("canary")),
            "nagios_service": F.when(F.col("canary"), F.lit("LogstashAlertTest")),
        }
    )


def alerts(df: DataFrame, tag: str = CANARY_TAG, status: int = 2) -> DataFrame:
    """One alert row per event that has the tag: host, service, status, text."""
    return df.filter(F.array_contains("tags", tag)).select(
        F.col("logsource").alias("alert_host"),
        F.col("nagios_service").alias("alert_service"),
        F.lit(status).cast("bigint").alias("alert_status"),
        F.concat_ws("  ", F.coalesce("timestamp", "timestamp8601"), "logsource").alias("alert_message"),
    )


def login_failures(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """Failed and invalid logins per time bucket, address and user."""
    bad = F.col("login_tag").isin("ssh_brute_force_attack", "ssh_failed_login")
    return (
        df.filter(bad)
        .groupBy(F.window("event_ts", width).start.alias("bucket"), "src_ip", "username")
        .agg(
            F.count("*").alias("failures"),
            F.count_if(F.col("login_tag") == "ssh_brute_force_attack").alias("invalid_users"),
        )
    )
