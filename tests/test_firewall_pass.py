"""Firewall lines of all kinds of devices are read, built and parsed in one pass."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from timberline.operators import syslog
from timberline.plans import indexing
from timberline.session import prepare

AT = dt.datetime(2024, 1, 10, 12, 0, 0)
SCHEMA = "type string, message string, host string, received_at timestamp, ingest_seq bigint, tags array<string>"
LINES = {
    "": [
        None,
        "",
        "nothing that a device writes",
        "<166>Jan 10 11:59:00: %ASA-6-302010: 5 in use, 9 most used",
        "<164>Jan 10 2024 11:59:01 fw1: %ASA-4-106015: Deny TCP (no connection) from 10.0.0.1/1 to 10.0.0.2/2 flags RST  on interface inside",
        "<164>Jan 10 11:59:01: %ASA-4-999999: 5 in use, 9 most used",
    ],
    "netscreen": [
        "Jan 10 11:58:00 h1 fw2: NetScreen device_id=fw2  [Root]system-notification-00257(traffic): "
        'start_time="2024-01-10 11:57:00" duration=3 policy_id=7 service=http proto=6 src zone=Trust dst zone=Untrust action=Permit '
        "sent=1 rcvd=2 src=10.0.0.1 dst=10.0.0.2 src_port=11 dst_port=80 src-xlated ip=10.0.0.3 port=12 dst-xlated ip=10.0.0.4 port=81 "
        "session_id=99 reason=Close - AGE OUT",
        "NetScreen device_id=cut off %SYS-5-CONFIG_I: ,TRAFFIC,",
    ],
    "ios": ["12: *Jan 10 11:57:00: %SYS-5-CONFIG_I: change 12", "no time %LINK-3-UPDOWN: ,TRAFFIC,"],
    "pan": ["Jan 10 11:56:00 pa1 1,2024/01/10 11:56:00,0008,TRAFFIC,end,eth1"],
}


def frame(spark, *messages):
    rows = [("firewall", m, "relay", AT, i, None if i % 2 else ["x", "cisco-asa"]) for i, m in enumerate(messages)]
    return prepare(spark).createDataFrame(rows, SCHEMA)


def told(row):
    return {k: v for k, v in row.asDict().items() if v is not None and k != "ingest_seq"}


def test_each_kind_as_its_own_parser_gives_it(spark):
    alone = {"": lambda df: indexing.flow_fingerprint(indexing.parse_asa(df)), **{k: p for k, (_, p) in indexing.FIREWALLS.items()}}
    types = dict(alone[""](frame(spark)).dtypes)
    mixed = indexing._parse_firewall(frame(spark, *(m for ms in LINES.values() for m in ms)))
    assert {c: t for c, t in mixed.dtypes if c in types} == types
    got = {r.message: r for r in mixed.collect()}
    assert len(got) == sum(map(len, LINES.values()))
    at = 0
    for kind, messages in LINES.items():
        own = alone[kind](frame(spark, *(m for ms in LINES.values() for m in ms)).where(F.col("ingest_seq").between(at, at + len(messages) - 1)))
        own = own.withColumns({c: F.col(c).try_cast(types[c]) for c, t in own.dtypes if types.get(c, t) != t})
        at += len(messages)
        for row in own.collect():
            assert told(got[row.message]) == told(row), (kind, row.message)


def test_one_read_for_all_kinds(spark, tmp_path):
    path = str(tmp_path / "lines")
    frame(spark, *(m for ms in LINES.values() for m in ms)).write.parquet(path)
    out = indexing.index_events({"firewall": spark.read.parquet(path)}).groupBy("ciscotag", "session_id", "mnemonic", "pan_time").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert sum(r["count"] for r in out.collect()) == sum(map(len, LINES.values()))


def test_logins_need_their_words(spark):
    login = "Jan 10 11:59:00 web1 sshd[7]: Accepted password for u1 from 10.0.0.1 port 22 ssh2"
    sudo = "Jan 10 11:59:00 web1 sudo: pam_unix(sudo:auth): authentication failure; logname=a uid=1 euid=0 tty=/dev/pts/1 ruser=a rhost= user=b"
    near = "Jan 10 11:59:00 web1 sshd: Accepted password for u1 from 10.0.0.1 port 22 ssh2"
    rows = syslog.parse_logins(frame(spark, login, sudo, near, "sshd[7]", None)).orderBy("ingest_seq").collect()
    assert [(r.login, r.login_tag) for r in rows] == [(True, "ssh_sucessful_login"), (True, "sudo_auth_failure")] + [(False, None)] * 3
    assert [r.username for r in rows][:1] == ["u1"] and rows[2].username is None
