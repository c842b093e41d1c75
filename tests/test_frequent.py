"""Top terms by cells against plain counts, and what they send."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.operators.frequent import cell_counts, frequent_terms
from timberline.operators.panels import top_terms
from timberline.session import prepare


def expected(terms, size, exclude):
    present = Counter(t for t in terms if t is not None and t not in exclude)
    top = sorted(present.items(), key=lambda p: (-p[1], p[0].encode()))[:size]
    rows = [("term", t, n) for t, n in top]
    rows.append(("other", None, sum(present.values()) - sum(n for _, n in top)))
    rows.append(("missing", None, sum(t is None for t in terms)))
    return sorted(rows, key=str)


def result(df, field="t", **options):
    return sorted([tuple(r) for r in frequent_terms(df, field, other=True, missing=True, **options).collect()], key=str)


# Few cells make many terms share one, so that bounds are loose.
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.one_of(st.none(), st.sampled_from(["", "a", "b", "é", "x" * 3000, "漢"]), st.integers(0, 40).map(str)), max_size=200),
    st.sampled_from([1, 3, 64]),
    st.integers(1, 5),
)
def test_equals_plain_counts(spark, terms, cells, size):
    prepare(spark)
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert result(df, size=size, exclude=["a", "7"], cells=cells) == expected(terms, size, {"a", "7"})


def test_even_terms_and_clashing_names(spark):
    """No cell can be ruled out: all are counted, ties by value."""
    prepare(spark)
    df = spark.range(5000).select(F.col("id").cast("string").alias("term"), F.lit(1).alias("n"), F.lit(1).alias("cell"), F.lit(1).alias("place_0"))
    assert result(df, "term", size=3, cells=16) == expected([str(i) for i in range(5000)], 3, set())


def test_kept_counts_add_up(spark):
    prepare(spark)
    df = spark.range(20_000).select((F.col("id") % 3).alias("day"), F.expr("cast(floor(sqrt(id)) as string)").alias("t"))
    kept = cell_counts(df, "t", by=["day"])
    assert {r["day"] for r in kept.select("day").distinct().collect()} == {0, 1, 2}
    terms = [r["t"] for r in df.collect()]
    assert result(df, size=7, counts=kept) == result(df, size=7) == expected(terms, 7, set())


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Two million different values of one event each, and a few of many; one holds a third of all rows."""
    prepare(spark)
    path = str(tmp_path_factory.mktemp("wide") / "rows")
    i = F.col("id")
    hot = F.when(i % 3 == 0, "hot").when(i % 7 == 0, F.concat(F.lit("warm"), (i % 20).cast("string")))
    spark.range(0, 3_500_000, 1, 8).select(F.coalesce(hot, F.sha1(i.cast("string"))).alias("t")).write.parquet(path)
    return spark.read.parquet(path)


def sent(spark, df) -> tuple[int, list]:
    """Bytes written to shuffles by a job, and its rows."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        return sum(store.executorList(True).apply(k).totalShuffleWrite() for k in range(store.executorList(True).size()))

    before = total()
    rows = sorted([tuple(r) for r in df.collect()], key=str)
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    return total() - before, rows


def test_sends_less_than_a_tenth(spark, wide):
    full, a = sent(spark, top_terms(wide, "t", 10, other=True, missing=True))
    cells, b = sent(spark, frequent_terms(wide, "t", 10, other=True, missing=True))
    print(f"bytes sent: {full} counting all terms, {cells} by cells")
    assert a == b
    assert cells * 10 < full


def test_cells_are_counted_once(spark, wide):
    df = frequent_terms(wide, "t", 10, other=True, missing=True)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and "CartesianProduct" not in final
