"""Single lines: optional parts, lines that must not match, and known quirks."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from timberline.functions import scalar
from timberline.functions.extract import FAILURE_TAG, parse
from timberline.functions.grammar import BLOCKS, block, line_pattern, register_pattern
from timberline.operators import cisco, firewall, nagios, quality, syslog, vmware, web
from timberline.session import prepare

AT = dt.datetime(2024, 1, 10, 12, 0, 0)


def lines(spark, *messages, kind="syslog"):
    rows = [(kind, m, "relay", AT, i, ["x"]) for i, m in enumerate(messages)]
    schema = "type string, message string, host string, received_at timestamp, ingest_seq bigint, tags array<string>"
    return prepare(spark).createDataFrame(rows, schema)


def one(df):
    return df.first().asDict()


def test_bsd_line_with_and_without_pid(spark):
    df = syslog.parse_syslog(
        lines(spark, "<34>Jan  5 01:02:03 web1 su[77]: hello: world", "<0>Jan 10 11:59:59 web1 kernel: panic", "no priority", None)
    )
    a, b, c, d = df.orderBy("ingest_seq").collect()
    assert (a.syslog_program, a.syslog_pid, a.syslog_message, a.message_remainder) == (
        "su", "77", "hello: world", "Jan  5 01:02:03 web1 su[77]: hello: world",
    )
    assert (a.syslog_facility, a.syslog_severity, a.event_ts) == ("security/authorization", "critical", dt.datetime(2024, 1, 5, 1, 2, 3))
    assert (b.syslog_pid, b.syslog_severity, b.syslog_facility_code) == (None, "emergency", 0)
    assert FAILURE_TAG in c.tags and c.msg == "no priority" and c.syslog_severity == "notice" and c.event_ts == AT
    assert FAILURE_TAG in d.tags and d.syslog_pri is None


def test_priority_only_line_keeps_remainder(spark):
    row = one(syslog.parse_syslog(lines(spark, "<13>   something else")))
    assert row["syslog_pri"] == 13 and row["message_remainder"] == "something else" and FAILURE_TAG in row["tags"]


def test_empty_message_is_not_a_failure(spark):
    row = one(syslog.parse_syslog(lines(spark, "<13>Jan  5 01:02:03 web1 su: ")))
    assert row["msg"] == "" and FAILURE_TAG not in row["tags"]


def test_december_line_in_january_and_leap_day(spark):
    df = prepare(spark).createDataFrame(
        [("Dec 31 23:59:00", dt.datetime(2024, 1, 1, 0, 1)), ("Feb 29 10:00:00", dt.datetime(2025, 2, 1)), ("Feb 30 10:00:00", AT)],
        "t string, r timestamp",
    )
    got = [r[0] for r in df.select(scalar.device_time(F.col("t"), F.col("r"))).collect()]
    assert got == [dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2024, 2, 29, 10), None]


def test_separator_in_a_line_is_escaped(spark):
    row = one(syslog.parse_syslog(lines(spark, "<13>Jan  5 01:02:03 web1 su: a\u0001b")))
    assert row["syslog_message"] == "a#001b" and FAILURE_TAG not in row["tags"]


def test_first_pattern_wins_over_earlier_position(spark):
    patterns = [line_pattern("b={v:word}"), line_pattern("a={v:word}")]
    assert one(parse(lines(spark, "a=1 b=2"), patterns))["v"] == "2"
    row = one(parse(lines(spark, "c=3"), patterns))
    assert row["v"] is None and row["parsed"] is False


def test_dollar_and_backslash_survive(spark):
    row = one(parse(lines(spark, r"v=$1 \2 \\ end"), line_pattern("v={v:rest}")))
    assert row["v"] == r"$1 \2 \\ end"


def test_blocks_have_no_capturing_groups():
    for name in BLOCKS:
        line_pattern(f"{{field:{name}}}")
    with pytest.raises(ValueError):
        register_pattern("bad", "(a|b)")
    with pytest.raises(ValueError):
        line_pattern("(a|b)")


@pytest.mark.parametrize(
    "name, yes, no",
    [
        ("ipv4", ["0.0.0.0", "255.255.255.255", "10.1.2.3"], ["256.1.1.1", "1.2.3", "1.2.3.4.5x"]),
        ("ipv6", ["::", "::1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "1::8", "1:2:3::7:8"], ["1:2:3", ":::", "g::1"]),
        ("uuid", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]),
        ("sdelement", ['[a@1 k="v"]', '[a@1 k="v\\]"][b]'], ["[a", "a"]),
        ("isotime", ["2024-01-05T01:02:03Z", "2024-01-05 01:02:03.123+02:00"], ["2024-13-05T01:02:03"]),
        ("quoted", ['"a \\" b"', '""'], ['"a', "'x'"]),
        ("uri", ["http://a.example.org:80/p/x?q=1", "git+ssh://u@h/p"], ["//a/b"]),
        ("tty", ["/dev/pts/3", "/dev/ttyp1"], ["/dev/null"]),
        ("datestamp", ["01/31/2024 10:11:12", "31.01.2024-10:11:12"], ["2024"]),
        ("loglevel", ["WARN", "Error", "emergency"], ["inform"]),
        ("nasport", ["eth0"], ["e0"]),
    ],
)
def test_blocks(spark, name, yes, no):
    rows = [(t, True) for t in yes] + [(t, False) for t in no]
    df = spark.createDataFrame(rows, "t string, want boolean")
    wrong = df.filter(F.col("t").rlike(f"^(?:{block(name)})$") != F.col("want")).collect()
    assert wrong == []


def test_login_forms_exclude_each_other(spark):
    head = "<38>Jan  5 01:02:03 web1 sshd[9]: "
    df = syslog.parse_logins(
        lines(
            spark,
            head + "Failed password for invalid user bob from 10.0.0.1 port 22 ssh2",
            head + "Failed password for bob from fe80::1 port 22 ssh2",
            head + "Accepted password for bob from 10.0.0.1 port 22 ssh2",
            "<38>Jan  5 01:02:03 web1 sudo: pam_unix(sudo:auth): authentication failure; logname=a uid=5 euid=0 tty=/dev/pts/1 ruser=a rhost=  user=root",
            head + "Connection closed",
        )
    )
    got = [(r.login_tag, r.username, r.src_ip, r.remote_host) for r in df.orderBy("ingest_seq").collect()]
    assert got == [
        ("ssh_brute_force_attack", "bob", "10.0.0.1", None),
        ("ssh_failed_login", "bob", "fe80::1", None),
        ("ssh_sucessful_login", "bob", "10.0.0.1", None),
        ("sudo_auth_failure", None, None, None),
        (None, None, None, None),
    ]


ASA_HEAD = "<166>Jan 10 2024 11:59:00 fw1: %ASA-6-"


def test_asa_unknown_id_and_wrong_id_try_the_families(spark):
    body = "Deny UDP reverse path check from 10.0.0.1 to 10.0.0.2 on interface outside"
    df = cisco.parse_asa(
        lines(spark, f"{ASA_HEAD}999999: {body}", f"{ASA_HEAD}302010: {body}", f"plain {body}", f"{ASA_HEAD}725001: SSL client", kind="firewall")
    )
    a, b, c, d = df.orderBy("ingest_seq").collect()
    for row in (a, b, c):
        assert (row.src_ip, row.dst_ip, row.interface, row.parsed) == ("10.0.0.1", "10.0.0.2", "outside", True)
    assert (a.header, a.asa_id, a.asa_family) == (True, 999999, None)
    assert (b.asa_id, b.connection_count) == (302010, None)
    assert c.header is False and FAILURE_TAG in c.tags
    assert d.header and not d.parsed and FAILURE_TAG in d.tags and d.src_ip is None


def test_asa_teardown_reason_and_user(spark):
    text = (
        ASA_HEAD + "302014: Teardown TCP connection 5 for outside:10.0.0.1/80(LOCAL\\bob) to inside:10.0.0.2/99 "
        "duration 26:00:01 bytes 12 TCP FINs (amy)"
    )
    row = one(cisco.parse_asa(lines(spark, text)))
    assert (row["reason"], row["user"], row["src_fwuser"], row["bytes"]) == ("TCP FINs", "amy", "LOCAL\\bob", 12)


def test_asa_acl_line_has_both_users(spark):
    text = ASA_HEAD + "106100: access-list a permitted tcp in/10.0.0.1(5)(u1) -> out/10.0.0.2(80)(u2) hit-cnt 1 first hit [0x1, 0x0]"
    row = one(cisco.parse_asa(lines(spark, text)))
    assert (row["src_fwuser"], row["dst_fwuser"], row["interval"], row["hit_count"]) == ("u1", "u2", "first hit", 1)


def test_asa_icmp_denied_by_acl(spark):
    text = ASA_HEAD + '106023: Deny icmp src outside:10.0.0.1 dst inside:10.0.0.2 (type 8, code 0) by access-group "out" [0x0, 0x0]'
    row = one(cisco.parse_asa(lines(spark, text)))
    assert (row["icmp_type"], row["icmp_code"], row["src_port"], row["policy_id"]) == (8, 0, None, '"out"')


def test_fingerprint_needs_tag_and_addresses(spark):
    import hashlib
    import hmac

    df = cisco.parse_asa(lines(spark, ASA_HEAD + "106021: Deny UDP reverse path check from 10.0.0.1 to 10.0.0.2 on interface o"))
    assert one(cisco.flow_fingerprint(df))["fingerprint"] is None
    tagged = df.withColumn("tags", F.array(F.lit("cisco-asa")))
    want = hmac.new(b"logstash", b"10.0.0.1|10.0.0.2||UDP", hashlib.sha1).hexdigest()
    assert one(cisco.flow_fingerprint(tagged))["fingerprint"] == want


def test_ios_star_colon_and_no_program(spark):
    df = cisco.parse_ios(lines(spark, "7: sw1: :*Jan  5 01:02:03 UTC: %SYS-5-CONFIG_I: done", ": Jan  5 2024 01:02:03: plain text"))
    a, b = df.orderBy("ingest_seq").collect()
    assert (a.counter, a.logsource, a.facility, a.severity, a.mnemonic, a.device_message) == (7, "sw1", "SYS", 5, "CONFIG_I", "done")
    assert (b.counter, b.program, b.device_message) == (None, None, "plain text")


def test_nagios_short_record_and_other_command(spark):
    df = nagios.parse_nagios(
        lines(
            spark,
            "[1700000000] SERVICE ALERT: web1;Load;OK",
            "[1700000000] EXTERNAL COMMAND: SCHEDULE_SVC_DOWNTIME;web1;Load;1;2",
            "[1700000000] EXTERNAL COMMAND: DISABLE_HOST_CHECK;web1",
            "[1700000000] LOG ROTATION: DAILY",
            "[1700000000] HOST EVENT HANDLER: web1;DOWN;SOFT;restart;now",
        )
    )
    rows = df.orderBy("ingest_seq").collect()
    assert [r.parsed for r in rows] == [False, True, True, False, True]
    assert (rows[1].nagios_command, rows[1].nagios_message) == ("SCHEDULE_SVC_DOWNTIME", "web1;Load;1;2")
    assert rows[2].nagios_hostname == "web1" and rows[4].nagios_event_handler_name == "restart;now"
    assert rows[0].nagios_hostname is None


def test_iptables_without_ports(spark):
    row = one(firewall.parse_iptables(lines(spark, "Jan  5 01:02:03 fw IPTables-DROP: IN=eth0 SRC=10.0.0.1 DST=10.0.0.2 PROTO=ICMP TYPE=8")))
    assert (row["iptables_action"], row["proto"], row["src_port"]) == ("DROP", "ICMP", None)


def test_access_log_quotes_and_bad_request(spark):
    df = web.parse_access_log(
        lines(spark, '10.0.0.1 - bob [05/Jan/2024:01:02:03 +0100] "-" 400 - "-" "a \\"b\\" c"', "garbage", kind="apache")
    )
    a, b = df.orderBy("ingest_seq").collect()
    assert (a.rawrequest, a.method, a.bytes, a.agent, a.event_ts) == ("-", None, None, '"a \\"b\\" c"', dt.datetime(2024, 1, 5, 0, 2, 3))
    assert FAILURE_TAG in b.tags and b.apache_vhost is None


def test_esxi_blank_before_opid_and_multiline(spark):
    text = "<166>2024-01-05T01:02:03.456Z esx1 Hostd: [7F info 'Vim' opID=a-1] [svc] first\n--> second"
    row = one(vmware.parse_esxi(lines(spark, text, kind="VMware")))
    assert (row["message_opID"], row["message_service_info"], row["syslog_message"]) == ("opID=a-1", "svc", "first\n--> second")
    assert row["event_ts"] == dt.datetime(2024, 1, 5, 1, 2, 3, 456000)


def test_rfc5424_names_and_structured_data(spark):
    """Names are printable characters, and there may be several elements of structured data."""
    a, b, c = syslog.parse_rfc5424(
        lines(
            spark,
            '<165>1 2024-01-05T01:02:03Z web1.example.org my-app 77 ID-47 [x@1 k="v\\]"][y@1 n="2"] text [with] brackets',
            "<34>1 - - - - - -",
            "<34>1 no",
        )
    ).orderBy("ingest_seq").collect()
    assert (a.syslog5424_app, a.syslog5424_msgid, a.syslog5424_sd) == ("my-app", "ID-47", '[x@1 k="v\\]"][y@1 n="2"]')
    assert a.syslog5424_msg == "text [with] brackets" and a.parsed and FAILURE_TAG not in a.tags
    assert b.parsed and b.syslog5424_host is None and not c.parsed and FAILURE_TAG in c.tags


def test_entities_at_run_starts(spark):
    df = lines(spark, "see xhttp://a.b/c, + ftp://d.e and bob@x.example.org or 10.0.0.1.").select("ingest_seq", "message")
    got = {(r.kind, r.value) for r in quality.entities(df, "message").collect()}
    assert got == {("url", "xhttp://a.b/c,"), ("url", "ftp://d.e"), ("user", "bob@x.example.org"), ("ip", "10.0.0.1")}


def test_interpolate_and_seconds(spark):
    df = spark.createDataFrame([("a", None, "26:00:01")], "x string, y string, d string")
    row = df.select(scalar.interpolate("%{x}-1"), scalar.interpolate("%{x}-%{y}"), scalar.seconds_of(F.col("d"))).first()
    assert tuple(row) == ("a-1", None, 93601)


@pytest.mark.parametrize(
    "text", ["word " * 40_000, "a." * 100_000, '"' + '\\"' * 100_000, "1" * 20_000, "/a" * 100_000, "x" * 200_000, "[" * 50_000, "::1 " * 30_000]
)
def test_long_lines_do_not_overflow_or_stall(spark, text):
    """Whole lines are processed, whatever they hold, without deep recursion."""
    head = '10.0.0.1 - - [05/Jan/2024:01:02:03 +0000] "GET / HTTP/1.1" 200 1 "-" '
    df = lines(spark, text, f"<13>Jan  5 01:02:03 web1 su: {text}", f"{ASA_HEAD}999999: {text}", head + text, kind="syslog").persist()
    jobs = [
        syslog.parse_syslog, syslog.parse_logins, syslog.parse_rfc5424, syslog.parse_generic, syslog.parse_pam, syslog.parse_cron,
        cisco.parse_asa, cisco.parse_ios, firewall.parse_netscreen, firewall.parse_iptables, web.parse_access_log, web.parse_iis,
        vmware.parse_esxi, vmware.parse_vcenter, vmware.parse_storage_health, nagios.parse_nagios,
    ]
    for job in jobs:
        began = time.time()
        assert len(job(df).collect()) == 4
        assert time.time() - began < 20, job.__name__
    found = quality.entities(df.select("ingest_seq", "message"), "message").count()
    assert found >= 1
    long = one(syslog.parse_syslog(df.filter("ingest_seq = 1")))
    assert long["syslog_message"] == text
    df.unpersist()
