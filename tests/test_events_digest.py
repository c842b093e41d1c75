"""The digest of the indexing stream's numbers, put together from chunks."""

from __future__ import annotations

import hashlib
import random

from timberline.suite import streams


def test_digest_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(streams, "CHUNK", 16)
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(-40, 200)) for _ in range(3000)] + [("a", None), ("c", None)]
    got = streams.events_digest(spark.createDataFrame(rows, "type string, ingest_seq long").repartition(7), "type")
    got = {r["type"]: (r["n"], r["digest"]) for r in got.collect()}
    for kind in "abc":
        own = [s for k, s in rows if k == kind]
        text = ",".join(map(str, sorted(s for s in own if s is not None)))
        assert got[kind] == (len(own), hashlib.md5(text.encode()).hexdigest())
