"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from timberline import suite
from tests.compare import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, entry.queries()[name], entry.oracle_sql()[name], FOLDER) == ""


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["panel", "series", "key", "n"]
    assert df.count() > 0
