"""Credential links against a plain search with Python's expressions, native plans, and odd texts."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from timberline.llm import credentials as C

KEY = "AKIA" + "IOSFODNN7EXAMPLE"
OPAQUE = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY00"


def plain(text: str | None) -> list[tuple[str, int, int, str]]:
    text = text or ""
    parts = []
    for m in re.finditer(C.ASSIGN, text):
        n = len(m[2])
        if n >= 4:
            parts.append(("assign" if n >= 12 else "short", m.start(), m.end()))
    parts += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    parts += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    parts += [("opaque", m.start(), m.end()) for m in re.finditer(C.OPAQUE, text) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    parts += [("login", m.start(), m.end()) for m in re.finditer(C.LOGIN, text)]
    parts += [("endpoint", m.start(), m.end()) for m in re.finditer(C.ENDPOINT, text)]
    breaks = [m.start() for m in re.finditer(C.BLANK_LINE, text)]
    role = {p.kind: p.role for p in C.PARTS}
    scope = {p: sum(b < p[1] for b in breaks) for p in parts}
    out = []
    for p in parts:
        near = [q for q in parts if scope[p] == scope[q] and q[1] <= p[2] + C.REACH and p[1] <= q[2] + C.REACH]
        kinds, roles = {q[0] for q in near}, {role[q[0]] for q in near}
        covered = any(q[0] in C.BASE and q[1] < p[2] and p[1] < q[2] for q in near)
        pair = "login" in kinds and "endpoint" in roles
        whole = {
            "short": "access" in kinds or pair,
            "opaque": not covered and ("access" in kinds or pair),
            "login": "endpoint" in roles and "secret" in roles,
            "endpoint": "secret" in roles and bool({"access", "login"} & kinds),
        }
        if p[0] in C.BASE or whole[p[0]]:
            out.append((p[0], p[1], p[2], text[p[1] : p[2]]))
    return sorted(out, key=lambda s: (s[1], C.KINDS.index(s[0])))


def texts() -> list[str | None]:
    rng = random.Random(11)
    bits = [
        "token = abcd", 'password: "hunter2x"', "PASSWD='longenoughvalue1'", "api_key=short12", "apikey: 0123456789abcdef0123", "username: ann", "Login=bob@example.org",
        KEY, "AKIASHORT", OPAQUE, "https://db.example.org/x?token=abcdefabcdefabcd", "ftp://h", "\n\n", "\n \t\r\n", "é漢😀", "words of prose", "deadbeefdeadbeef", "x" * 150, " ", "client_id=a1", "ſecret=notasciiletters", "toKen==abcdefghijk", "secret\"=\"zzzzzzzzzzzzzz",
    ]
    out: list[str | None] = [rng.choice([" ", "\n", ", ", ""]).join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(250)]
    return out + [None, "", " ", "a" * 100_000, ("token=secret=abcdefabcdef " + KEY + " ") * 3000, "https://" + "h" * 100_000 + " user=a secret=bbbbb", "A0a" * 50_000]


def test_against_plain_search(spark):
    rows = list(enumerate(texts())) + [(3, "token = abcdefabcdefabcd"), (None, f"{KEY} {OPAQUE}"), (None, f"{KEY} {OPAQUE}")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kind string, row long").repartition(7)
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in C.credentials(df).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted(got, key=order) == sorted(((i, plain(t)) for i, t in rows), key=order)


def test_report_columns(spark):
    text = f"{KEY} and {OPAQUE} at noon"
    row = C.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (0, 1, 0)
    assert row["base_sha256"] == hashlib.sha256(b"access:0:20").hexdigest() and row["spans"] == "access:0:20,opaque:25:65"


def test_weak_parts_alone_are_left_alone(spark):
    far = "word " * 60
    rows = [f"see {OPAQUE}", "user=ann password=abcde", f"{KEY} {far} {OPAQUE}", f"{KEY}\n\n{OPAQUE}", "https://example.org login=ann"]
    out = C.credentials(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {s["kind"] for r in out.collect() for s in r["spans"]} == {"access"}


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert C.report(df).collect() == []
    plan = C.report(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert C.report(df.withColumn("n", F.lit(1)), ["doc_id", "n"]).columns[:2] == ["doc_id", "n"]
