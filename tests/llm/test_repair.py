"""Conversation repair against a search of all edits, on given and on odd rows, in whole and in chunks."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from timberline.llm import repair, suite

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def legal(done: str) -> bool:
    """Whether roles can still become (s?(ua)+)?"""
    return re.fullmatch(r"s?(ua)*u?", done) is not None


def cheapest(rows: list[tuple], fault: list[str]) -> tuple[int, str, list[tuple[str, str]]]:
    """Dijkstra over (cost, audit): the first finished one is the cheapest, and of those the least."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, said = heapq.heappop(heap)
        key = (i, roles[-2:] if len(roles) > 1 else roles, roles.startswith("s"))
        if (key, cost, audit) in seen or not legal(roles) or len(roles) > len(rows) + 6:
            continue
        seen.add((key, cost, audit))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(said)
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, said))
            if fault[i] in ("", "truncated"):
                extra = fault[i] == "truncated"
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + (role[:1] or "?"), (*said, (role, text))))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, roles + name[0], (*said, (name, text))))
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + name[0], (*said, (name, ""))))
    raise AssertionError("no repair")


def report(rows: list[tuple]) -> tuple:
    rows = ordered(rows)
    fault = faults(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(rows, rows[1:])]
    cost, audit, said = cheapest(rows, fault)
    text = "\n".join(f"{r}:{t}" for r, t in said)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def by_conversation(rows: list[tuple], damage: bool) -> dict:
    out: dict = {r[0]: [] for r in rows}
    for r in damaged(rows) if damage else rows:
        out[r[0]].append(r)
    return {c: report(x) for c, x in out.items()}


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in suite.QUERIES["op13_repair"](spark, folder).collect()}
    assert got == by_conversation(rows, True)


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    texts = ["Yes.", "no", "", " \t\n", "What?", "Half a sentence and", "x" * 200_000 + "!", None, "Yes. \n", "É!"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles[:3] * 3 + roles), rng.choice(texts)) for c in range(120) for t in range(rng.randrange(1, 7))]
    rows += [(None, t, "user", "no id.") for t in (3, None, 3)]
    rows += [(500, 7, "user", "same.")] * 5 + [(501, None, "assistant", "a."), (501, None, "user", "b.")]
    return rows


def test_odd_rows_and_columns(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA + ", cid string, word string, place string").repartition(5)
    got = repair.repair_damaged(df).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == by_conversation(rows, True) and len(got) == len({r[0] for r in rows})
    assert repair.repair_damaged(df.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_chunks_change_nothing(spark, monkeypatch, bits):
    """Chunks of one to four rows cut every conversation; their maps must join up."""
    rng = random.Random(bits)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c?", "d!", f"{c}."])) for c in range(40) for t in range(rng.randrange(1, 9))]
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    got = {r["cid"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {str(c): x for c, x in by_conversation(rows, False).items()}


def test_few_classes_and_shared_nodes():
    assert len(repair.CLASSES) < 100
    suffixes = repair.Suffixes()
    word = "EIEI" * 300
    first = suffixes.add(word, -1)
    size = len(suffixes.next)
    assert suffixes.add(word[2:], -1) < first and suffixes.add("A" + word, -1) >= size and len(suffixes.next) == size + 1
    assert suffixes.best(first, 0, -1) == (0, "K" * len(word))
