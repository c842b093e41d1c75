"""The queries on whole given tables: against SQL, against brute force, by held-out accuracy."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.compare import compare, connect
from timberline.llm import suite

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(suite.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, suite.QUERIES[name], suite.ORACLES[name], FOLDER) == ""


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in suite.QUERIES) == list(range(1, 14))


def test_token_files_round_trip(spark, duck):
    """Whole texts by the tokenizer alone, in ascending doc_id order."""
    tokenizer = Tokenizer.from_file(suite.tokenizer_path())
    want, start = [], 0
    for doc_id, text in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = suite.QUERIES["op5_token_files"](spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def plain_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split(" ")]
    words = [w for part in words for w in _split(part) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(part: str) -> list[str]:
    for c in "\n\x0b\x0c\r":
        part = part.replace(c, " ")
    return part.split(" ")


def test_simhash_against_all_pairs(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    want = sorted((doc_id, f"{fps[i]:016x}", low[find(i)]) for i, (doc_id, _) in enumerate(rows))
    got = suite.QUERIES["op7_simhash"](spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


def test_language_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = suite.QUERIES["op1_language"](spark, folder).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["accepted"] for r in rows) / len(rows) > 0.99


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    scored = suite.QUERIES["op4_toxicity"](spark, folder).cache()
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    above = np.mean([(t > np.array(clean)).mean() + (t == np.array(clean)).mean() / 2 for t in toxic])
    assert above > 0.93  # the area under the curve
    assert np.mean([s >= 0.5 for s in clean]) < 0.01 and np.mean([s >= 0.5 for s in toxic]) > 0.7


def test_chat_costs_and_text(spark):
    folder = FOLDER
    given = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    rows = suite.QUERIES["op8_chat"](spark, folder).collect()
    assert sum(r["action"] != "insert" for r in rows) == len(given)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    assert set(by) == {r["conv_id"] for r in given}
    for pieces in by.values():
        text = "".join(r["rendered"] for r in sorted(pieces, key=lambda r: (r["chunk"], r["place"], r["piece"])))
        assert text.endswith("<|end|>\n") and text.count("<|end|>") == sum(not r["action"].startswith("merge") for r in pieces)
