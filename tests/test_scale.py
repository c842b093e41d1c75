"""Plans and the paths that only large or skewed inputs take."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from timberline import suite
from timberline.functions.scalar import ipv4_number
from timberline.operators.enrich import dimension_join, geo_enrich, host_resolve
from timberline.operators.multiline import assemble
from timberline.operators.panels import auto_interval, top_terms
from timberline.plans.indexing import index_events
from timberline.session import prepare

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# The three joins of a dashboard's or table's own making are all equi-joins.
@pytest.mark.parametrize("name", [n for n in suite.QUERIES if not n.startswith("stream_")])
def test_plans_have_no_python_and_no_cross_join(spark, name):
    plan = plan_of(suite.QUERIES[name](spark, FOLDER))
    for word in ("PythonUDF", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Scan ExistingRDD"):
        assert word not in plan, word


def test_dashboard_scans_once(spark):
    df = suite.QUERIES["dashboard_central"](spark, FOLDER)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_dashboard_parses_each_line_once(spark):
    """The line regex stands once in the plan of the shared stage, not once per filter."""
    df = suite.QUERIES["dashboard_central"](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace(replace(") == plan.count("Relation [")


def test_top_terms_uses_bounded_top_k(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    assert "TakeOrderedAndProject" in plan_of(top_terms(df, "k"))


@pytest.fixture(scope="module")
def facts(spark):
    prepare(spark)
    rng = random.Random(3)
    # One address holds a third of all rows; some rows have none.
    rows = []
    for i in range(3000):
        ip = "10.1.0.7" if i % 3 == 0 else (None if i % 11 == 0 else f"10.{rng.randrange(6)}.{rng.randrange(300)}.{rng.randrange(256)}")
        rows.append((i, ip, ["t"]))
    return spark.createDataFrame(rows, "id bigint, ip string, tags array<string>").repartition(6)


@pytest.fixture(scope="module")
def blocks(spark):
    prepare(spark)
    ranges = [("10.0.0.0", "10.0.127.255", "a"), ("10.0.128.0", "10.2.3.255", "b"), ("10.4.0.0", "10.4.255.255", "")]
    df = spark.createDataFrame(ranges, "s string, e string, city string")
    empty = ["continent_code", "country_code2", "country_code3", "country_name", "postal_code", "region_name", "time_zone"]
    geo = F.struct(
        F.col("city").alias("city_name"), *[F.lit("").alias(n) for n in empty], F.lit(1.5).alias("latitude"), F.lit("2.5").alias("longitude")
    )
    return df.select(ipv4_number(F.col("s")).alias("start_ip"), ipv4_number(F.col("e")).alias("end_ip"), geo.alias("geoip"))


def _number(ip):
    parts = [int(p) for p in ip.split(".")]
    return None if max(parts) > 255 else sum(p << s for p, s in zip(parts, (24, 16, 8, 0)))


def test_geo_join_broadcast_and_salted_equal_brute_force(facts, blocks):
    ranges = [(r.start_ip, r.end_ip, r.geoip.city_name) for r in blocks.collect()]
    want = {}
    for r in facts.collect():
        n = _number(r.ip) if r.ip else None
        hit = [c for s, e, c in ranges if n is not None and s <= n <= e]
        want[r.id] = (bool(hit), (hit[0] or None) if hit else None)
    for salts in (0, 5):
        df = geo_enrich(facts, "ip", blocks, salts=salts)
        assert "NestedLoop" not in plan_of(df)
        rows = df.select("id", "geoip", "tags").collect()
        got = {r.id: (r.geoip is not None, r.geoip.city_name if r.geoip else None) for r in rows}
        assert len(rows) == 3000 and got == want
        assert all(("geoip" in r.tags) == want[r.id][0] for r in rows)
        assert all(list(r.geoip.coordinates) == [2.5, 1.5] for r in rows if r.geoip)


def test_salted_join_spreads_the_hot_key(spark, facts):
    dim = spark.createDataFrame([("10.1.0.7", "hot")], "ip string, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = dimension_join(facts, dim, ["ip"], salts=6)
        per_task = df.filter("name = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per_task) == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_host_resolve_keeps_known_values(spark):
    hosts = spark.createDataFrame([("a", "1.1.1.1"), ("a", "2.2.2.2")], "hostname string, ip string")
    df = spark.createDataFrame([("a", None), ("a", "9.9.9.9"), ("b", None)], "h string, source_host_ip string")
    got = [r.source_host_ip for r in host_resolve(df, "h", hosts).collect()]
    assert sorted(got) == ["1.1.1.1", "9.9.9.9", "b"]


def brute(rows):
    """Events as a plain loop: (source, start) -> lines."""
    out = {}
    for source in {r[0] for r in rows}:
        start = None
        for _, seq, text in sorted(r for r in rows if r[0] == source):
            if start is None or not text.startswith("-->"):
                start = seq
            out.setdefault((source, start), []).append(text)
    return {k: "\n".join(v) for k, v in out.items()}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b"]), st.booleans(), st.integers(1, 5)), min_size=1, max_size=40),
    st.sampled_from([3, 4, 1000]),
)
def test_assembly_across_chunks_equals_brute_force(spark, picks, chunk):
    rows, seq = [], 0
    for source, more, gap in picks:
        seq += gap
        rows.append((source, seq, f"--> {seq}" if more else f"start {seq}"))
    df = spark.createDataFrame(rows, "host string, seq bigint, message string")
    out = assemble(df, "host", "seq", "^-->", chunk=chunk).collect()
    assert {(r.host, r.seq): r.message for r in out} == brute(rows)


def test_sparse_sequences_are_not_cut_and_missing_ones_are_refused(spark):
    """Two lines of one event that lie far apart, as offsets or times do, stay together."""
    rows = [("a", 1, "start"), ("a", 5_000_000_000, "--> on"), ("a", 9_000_000_000_000, "--> end"), (None, 3, "alone")]
    df = spark.createDataFrame(rows, "host string, seq bigint, message string")
    got = {(r.host, r.seq): r.message for r in assemble(df, "host", "seq", "^-->").collect()}
    assert got == {("a", 1): "start\n--> on\n--> end", ("", 3): "alone"}
    with pytest.raises(Exception, match="needs seq"):
        assemble(df.withColumn("seq", F.lit(None).cast("bigint")), "host", "seq", "^-->").collect()


def test_unknown_types_reach_the_default_family(spark):
    """Every row in is a row out, whatever its type."""
    rows = [(t, "x", "h", dt.datetime(2024, 1, 5), i, ["t"]) for i, t in enumerate(["haproxy", None, "redis", "nginx", "syslog", "nagios", "iis"])]
    rows.append(("iis", None, "h", dt.datetime(2024, 1, 5), 9, ["t"]))
    schema = "type string, message string, host string, received_at timestamp, ingest_seq bigint, tags array<string>"
    out = index_events(spark.createDataFrame(rows, schema)).select("type", "index_name", "event_ts").collect()
    assert sorted(str(r.type) for r in out) == sorted(str(r[0]) for r in rows)
    assert {r.index_name for r in out if r.type != "syslog"} == {"logstash-2024.01.05"}


def test_live_histogram_forgets_closed_buckets(spark, tmp_path):
    """State of closed buckets is removed while the stream goes on."""
    from timberline.streaming.jobs import current_histogram, live_histogram

    start = dt.datetime(2024, 1, 1)
    for i in range(4):
        rows = [("s", start + dt.timedelta(hours=6 * i, minutes=5 * m)) for m in range(60)]
        spark.createDataFrame(rows, "series string, event_ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("series string, event_ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = live_histogram(lines, str(tmp_path / "out"), str(tmp_path / "check"), "5m", "10 minutes", interval=None)
    run.awaitTermination(120)
    removed = sum(s["numRowsRemoved"] for p in run.recentProgress for s in p["stateOperators"])
    assert removed > 0
    assert current_histogram(spark, str(tmp_path / "out")).count() == 240


def test_assembly_never_shuffles_lines_on_the_source_alone(spark):
    df = spark.createDataFrame([("a", 1, "x")], "host string, seq bigint, message string")
    plan = plan_of(assemble(df, "host", "seq", "^-->"))
    for line in plan.splitlines():
        if "Exchange hashpartitioning(host" in line and not any(k in line for k in ("_chunk", "_event", "_group")):
            # only the summaries of groups of chunks may be gathered per source: they carry no message
            below = plan[plan.index(line) : plan.index(line) + 400]
            assert "_gfirst" in below and "message" not in below


def test_auto_interval_matches_the_shipped_panels():
    import datetime as dt

    want = {12: "5m", 24: "10m", 24 * 7: "1h", 24 * 30: "3h", 0.05: "1s"}
    assert {h: auto_interval(dt.timedelta(hours=h)) for h in want} == want
