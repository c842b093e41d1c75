"""NetScreen sessions, iptables kernel lines, Palo Alto traffic lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import matches, parse
from timberline.functions.grammar import block, line_pattern
from timberline.functions.tags import add_tags, failed

# Fixed value: the session record as the device writes it.
NETSCREEN = line_pattern(
    r"{date:syslogtime} {device:iporhost} {:iporhost}: NetScreen device_id={device_id:word}.*?: "
    r"start_time={start_time:quoted} duration={duration:int} policy_id={policy_id:int} service={service:data} "
    r"proto={proto:int} src zone={src_zone:word} dst zone={dst_zone:word} action={action:word} "
    r"sent={sent:int} rcvd={rcvd:int} src={src_ip:iporhost} dst={dst_ip:iporhost} "
    r"src_port={src_port:int} dst_port={dst_port:int} "
    r"src-xlated ip={src_xlated_ip:iporhost} port={src_xlated_port:int} "
    r"dst-xlated ip={dst_xlated_ip:iporhost} port={dst_xlated_port:int} "
    r"session_id={session_id:int} reason={reason:rest}"
)
NETSCREEN_LONGS = [
    "duration", "policy_id", "proto", "sent", "rcvd", "src_port", "dst_port",
    "src_xlated_port", "dst_xlated_port", "session_id",
]

# The kernel writes its KEY=VALUE pairs in this order; any may be missing.
IPTABLES = line_pattern(
    r"IPTables-{iptables_action:word}(?:.*?\bSRC={src_ip:ip})?(?:.*?\bDST={dst_ip:ip})?"
    r"(?:.*?\bPROTO={proto:word})?(?:.*?\bSPT={src_port:int})?(?:.*?\bDPT={dst_port:int})?"
)


def parse_netscreen(df: DataFrame) -> DataFrame:
    return parse(df, NETSCREEN, longs=NETSCREEN_LONGS)


def parse_iptables(df: DataFrame) -> DataFrame:
    """Action, protocol, addresses and ports of lines the firewall logged."""
    is_iptables = F.coalesce(F.col("message").contains("IPTables"), F.lit(False))
    df = parse(df, IPTABLES, longs=["src_port", "dst_port"], tag=False, when=is_iptables)  # most lines are of another kind
    tags = add_tags(F.col("tags"), "IPTABLES", when=is_iptables)
    return df.withColumn("tags", failed(tags, F.col("parsed") | ~is_iptables))


def parse_pan(df: DataFrame) -> DataFrame:
    """Palo Alto lines: traffic or not, log time, network port name, and the rest as command."""
    message = F.col("message")
    return df.withColumns(
        {
            "is_traffic": matches(message, ",TRAFFIC,"),
            "pan_time": F.nullif(F.regexp_extract(message, f"({block('patime')})", 1), F.lit("")),
            "command": F.nullif(F.regexp_extract(message, f"{block('patime')} ({block('command')})", 1), F.lit("")),
            "nas_port": F.nullif(F.regexp_extract(message, rf"\b({block('nasport')})\b", 1), F.lit("")),
        }
    )
