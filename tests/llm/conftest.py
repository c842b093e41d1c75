"""Tables with every odd case: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

#: Names that the operators use inside.
CLASHES = "fp row score lang_pred accepted features copies key h r block n size rank target probability prediction part uid words".split()
LONG = "and a long text of many words " * 40_000
RUN = "x" * 300_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog\tnear the river bank today", "en", None),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, " \t\n ", "fr", ""),
    (6, LONG, "en", "a"),
    (7, RUN, "fr", "c"),
    (8, "12 34 !!", "fr", "c"),
    (9, "Le petit chat noir dort sur la chaise bleue de la cuisine pendant que la pluie tombe", "fr", "c"),
    (10, "one", "en", "é"),
    (11, "one two", "en", "é"),
    (None, "a row without an id", "en", "a"),
    (None, "a row without an id", "en", "a"),
    (12, "nul \x00 and\x0bvertical\x0ctab 漢字 text", "en", "a"),
    (-3, "a negative id", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    rows = [(*r, len(r[1]) if r[1] is not None else None, *("x" for _ in CLASHES)) for r in ROWS]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
