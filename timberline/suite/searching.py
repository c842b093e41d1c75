"""Search predicates and dashboard panels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from timberline.fixtures import lines as L
from timberline.functions import search as S
from timberline.functions.tags import tags_by_type
from timberline.operators import panels as P
from timberline.operators.frequent import frequent_terms
from timberline.operators import syslog, windows
from timberline.plans.dashboards import CENTRAL, LOCKOUTS, WINDOWS
from timberline.session import latest, spread, table
from timberline.suite import query
from timberline.suite.parsing import geo_events, second

SECOND = "%Y-%m-%d %H:%M:%S"
HOST = "('host' || cast(user_id % 10 as varchar))"


def log_events(spark, folder):
    """``events`` as searchable events: program and severity from its type."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").alias("event_ts"),
        F.expr(L.HOST).alias("source_host"),
        F.col("event_type").alias("program"),
        "user_id",
        "value",
    )


def named_queries():
    kind = F.col("program")
    return [
        S.NamedQuery("all", S.everything()),
        S.NamedQuery("errors", S.equals(kind, "error"), pinned=True),
        S.NamedQuery("big", F.col("value") > 50, pinned=True),
        S.NamedQuery("off", S.equals(kind, "view"), enabled=False),
    ]


ORDER = ["all", "errors", "big"]
_SERIES = (
    "series AS (SELECT *, 'all' AS series FROM events UNION ALL SELECT *, 'errors' FROM events WHERE event_type = 'error' "
    "UNION ALL SELECT *, 'big' FROM events WHERE value > 50)"
)


def _hist(width: str) -> str:
    return f"h AS (SELECT series, time_bucket(INTERVAL '{width}', ts) AS bucket, count(*) AS n FROM series GROUP BY ALL)"


def _counts(spark, folder, interval):
    return P.histogram(S.by_query(log_events(spark, folder), S.pick(named_queries())), interval)


# --- predicates ---------------------------------------------------------------
_BOUNDARY = r"(^|[^0-9A-Za-z_])"


def _texts(spark, folder):
    docs = table(spark, folder, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    talks = table(spark, folder, "conversations").select(F.lit("talk").alias("kind"), F.col("conv_id").alias("id"), "text")
    return spread(docs).unionByName(spread(talks))


_TEXTS = "t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'talk', conv_id, text FROM conversations)"


@query(
    "search_phrase",
    rf"""WITH {_TEXTS} SELECT kind, id, count(*) AS n FROM t
    WHERE regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])of[^\p{{L}}\p{{M}}\p{{N}}_]+the([^\p{{L}}\p{{M}}\p{{N}}_]|$)') OR regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])de[^\p{{L}}\p{{M}}\p{{N}}_]+la([^\p{{L}}\p{{M}}\p{{N}}_]|$)') GROUP BY ALL""",
)
def search_phrase(spark, folder):
    text = F.col("text")
    hits = _texts(spark, folder).filter(S.phrase(text, "of the") | S.phrase(text, "de la"))
    return hits.groupBy("kind", "id").agg(F.count("*").alias("n"))


@query(
    "search_term",
    rf"""WITH {_TEXTS} SELECT kind, id, count(*) AS n FROM t WHERE list_contains(regexp_split_to_array(lower(text), '\s+'), 'that') GROUP BY ALL""",
)
def search_term(spark, folder):
    return _texts(spark, folder).filter(S.term(F.col("text"), "That")).groupBy("kind", "id").agg(F.count("*").alias("n"))


@query(
    "search_conjunction",
    """SELECT event_id, 'host' || cast(user_id % 10 as varchar) AS source_host FROM events WHERE event_type = 'error' AND event_id % 50 <> 0""",
)
def search_conjunction(spark, folder):
    df = syslog.parse_syslog(L.syslog_lines(spark, folder))
    both = S.equals(F.col("syslog_program"), "sshd") & S.phrase(F.col("msg"), "failed PASSWORD")
    return df.filter(both).select(F.col("ingest_seq").alias("event_id"), "source_host")


@query(
    "search_field_compare",
    f"""SELECT event_id, user_id % 20 = event_id % 20 AS same FROM events WHERE NOT ({L.CORRUPT})""",
)
def search_field_compare(spark, folder):
    df = windows.normalize_eventlog(L.eventlog_lines(spark, folder))
    a, b = F.col("SubjectUserName"), F.col("TargetUserName")
    equal = df.filter(S.same(a, b) | S.different(a, b))
    return equal.select(F.col("ingest_seq").alias("event_id"), S.same(a, b).alias("same"))


@query(
    "time_range_filter",
    "SELECT span, n FROM (SELECT "
    + ", ".join(
        f"count(*) FILTER (ts >= m - INTERVAL '{int(s.total_seconds())} seconds') AS \"{n}\"" for n, s in S.TIME_RANGES.items()
    )
    + " FROM events, (SELECT max(ts) AS m FROM events)) UNPIVOT (n FOR span IN ("
    + ", ".join(f'"{n}"' for n in S.TIME_RANGES)
    + "))",
)
def time_range_filter(spark, folder):
    df = log_events(spark, folder)
    as_of = latest(df, "event_ts")
    spans = [S.NamedQuery(span, S.since(F.col("event_ts"), as_of, span)) for span in S.TIME_RANGES]
    widest = df.filter(S.since(F.col("event_ts"), as_of, "30d"))
    return P.hits(S.by_query(widest, spans, "span"), "span")


# --- histograms ---------------------------------------------------------------
@query(
    "panel_histogram",
    f"WITH {_SERIES}, {_hist('5 minutes')} SELECT series, strftime(bucket, '{SECOND}') AS bucket, n FROM h",
)
def panel_histogram(spark, folder):
    return _counts(spark, folder, "5m").withColumn("bucket", second("bucket"))


@query(
    "multi_query_histogram",
    f"WITH {_SERIES}, {_hist('1 hour')} SELECT series, strftime(bucket, '{SECOND}') AS bucket, n FROM h WHERE series <> 'all'",
)
def multi_query_histogram(spark, folder):
    pinned = S.pick(named_queries(), "pinned")
    df = S.by_query(log_events(spark, folder), pinned)
    return P.histogram(df, "1h").withColumn("bucket", second("bucket"))


def _grid(width: str) -> str:
    return f"""g AS (SELECT s.series, b.bucket FROM (SELECT unnest(['all', 'errors', 'big']) AS series) s,
    (SELECT unnest(generate_series(time_bucket(INTERVAL '{width}', min(ts)), time_bucket(INTERVAL '{width}', max(ts)), INTERVAL '{width}')) AS bucket FROM events) b),
    z AS (SELECT g.series, g.bucket, coalesce(h.n, 0) AS n FROM g LEFT JOIN h ON g.series = h.series AND g.bucket = h.bucket)"""


def _filled(spark, folder, interval):
    df = log_events(spark, folder)
    ends = df.agg(F.date_format(F.min("event_ts"), "yyyy-MM-dd HH:mm:ss").alias("a")).first()["a"]
    start = dt.datetime.strptime(ends, "%Y-%m-%d %H:%M:%S").replace(tzinfo=dt.timezone.utc)
    return P.zero_fill(_counts(spark, folder, interval), start, latest(df, "event_ts"), interval, ORDER)


@query(
    "panel_histogram_zerofill",
    f"WITH {_SERIES}, {_hist('5 minutes')}, {_grid('5 minutes')} SELECT series, strftime(bucket, '{SECOND}') AS bucket, cast(n as bigint) AS n FROM z",
)
def panel_histogram_zerofill(spark, folder):
    return _filled(spark, folder, "5m").withColumn("bucket", second("bucket"))


@query(
    "panel_histogram_auto",
    f"""WITH {_SERIES}, spans AS (SELECT unnest(['12h', '24h', '7d', '30d']) AS span, unnest([43200, 86400, 604800, 2592000]) AS secs, unnest([300, 600, 3600, 10800]) AS width),
    m AS (SELECT max(ts) AS as_of FROM events)
    SELECT span, series, strftime(make_timestamp(cast(floor(epoch(ts) / width) as bigint) * width::BIGINT * 1000000), '{SECOND}') AS bucket, count(*) AS n
    FROM series, spans, m WHERE series = 'all' AND epoch_us(ts) >= epoch_us(as_of) - secs::BIGINT * 1000000 GROUP BY ALL""",
)
def panel_histogram_auto(spark, folder):
    """One scan: each event is put in the buckets of every range that holds it."""
    df = log_events(spark, folder)
    as_of = latest(df, "event_ts")
    ts = F.col("event_ts")
    cells = [
        F.when(
            S.since(ts, as_of, span),
            F.struct(F.lit(span).alias("span"), P.bucket(ts, P.auto_interval(S.TIME_RANGES[span])).alias("bucket")),
        )
        for span in ("12h", "24h", "7d", "30d")
    ]
    df = S.by_query(df.filter(S.since(ts, as_of, "30d")), S.pick(named_queries(), "unpinned"))
    df = df.select("series", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("series", "c.*")
    return df.groupBy("span", "series", second("bucket").alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "panel_histogram_value",
    f"""WITH {_SERIES} SELECT series, strftime(time_bucket(INTERVAL '3 hours', ts), '{SECOND}') AS bucket, round(avg(value) * 2, 6) AS mean, min(value) * 2 AS min,
    max(value) * 2 AS max, round(sum(value) * 2, 4) AS total FROM series GROUP BY series, time_bucket(INTERVAL '3 hours', ts)""",
)
def panel_histogram_value(spark, folder):
    df = S.by_query(log_events(spark, folder), S.pick(named_queries()))
    out = P.value_histogram(df, "3h", "value", ["mean", "min", "max", "total"], scale=2)
    return out.withColumns({"bucket": second("bucket"), "mean": F.round("mean", 6), "total": F.round("total", 4)})


@query(
    "panel_histogram_calendar",
    f"""WITH {_SERIES} SELECT unit, series, strftime(bucket, '{SECOND}') AS bucket, count(*) AS n FROM (
    SELECT '1w' AS unit, series, date_trunc('week', ts) AS bucket FROM series UNION ALL SELECT '1M', series, date_trunc('month', ts) FROM series) GROUP BY ALL""",
)
def panel_histogram_calendar(spark, folder):
    df = S.by_query(log_events(spark, folder), S.pick(named_queries()))
    ts = F.col("event_ts")
    cells = F.array(*[F.struct(F.lit(u).alias("unit"), second(P.bucket(ts, u)).alias("bucket")) for u in ("1w", "1M")])
    return df.select("series", F.inline(cells)).groupBy("unit", "series", "bucket").agg(F.count("*").alias("n"))


@query(
    "panel_histogram_derivative",
    f"""WITH {_SERIES}, {_hist('1 hour')}, {_grid('1 hour')} SELECT series, strftime(bucket, '{SECOND}') AS bucket, cast(n as bigint) AS n,
    cast(n - lag(n) OVER (PARTITION BY series ORDER BY bucket) as bigint) AS change FROM z""",
)
def panel_histogram_derivative(spark, folder):
    return P.derivative(_filled(spark, folder, "1h")).withColumn("bucket", second("bucket"))


@query(
    "panel_histogram_percent",
    f"""WITH {_SERIES}, {_hist('1 hour')} SELECT series, strftime(bucket, '{SECOND}') AS bucket, n, round(n * 100.0 / sum(n) OVER (PARTITION BY bucket), 6) AS percent FROM h""",
)
def panel_histogram_percent(spark, folder):
    df = P.percent(_counts(spark, folder, "1h"))
    return df.select("series", second("bucket").alias("bucket"), "n", F.round("percent", 6).cast("double").alias("percent"))


@query(
    "panel_histogram_cumulative",
    f"""WITH {_SERIES}, {_hist('1 hour')} SELECT series, strftime(bucket, '{SECOND}') AS bucket, n,
    cast(sum(n) OVER (PARTITION BY bucket ORDER BY list_position(['all', 'errors', 'big'], series)) as bigint) AS stacked FROM h""",
)
def panel_histogram_cumulative(spark, folder):
    return P.cumulative(_counts(spark, folder, "1h"), ORDER).withColumn("bucket", second("bucket"))


@query("panel_hits", f"WITH {_SERIES} SELECT series, count(*) AS n FROM series GROUP BY ALL")
def panel_hits(spark, folder):
    return P.hits(S.by_query(log_events(spark, folder), S.pick(named_queries())))


@query(
    "panel_sparklines",
    f"""WITH {_SERIES}, {_hist('1 day')} SELECT series, string_agg(strftime(bucket, '%Y-%m-%d') || '=' || cast(n as varchar), ',' ORDER BY bucket) AS points FROM h GROUP BY series""",
)
def panel_sparklines(spark, folder):
    df = P.sparklines(log_events(spark, folder), S.pick(named_queries()), "1d")
    points = F.transform("points", lambda p: F.concat(F.date_format(p["bucket"], "yyyy-MM-dd"), F.lit("="), p["n"].cast("string")))
    return df.select("series", F.array_join(points, ",").alias("points"))


# --- top terms ----------------------------------------------------------------
def _top(field: str, n: int, source: str = "events", where: str = "true") -> str:
    return f"SELECT 'term' AS kind, cast({field} as varchar) AS term, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL ORDER BY n DESC, term LIMIT {n}"


@query("panel_top_hosts", _top(HOST, 10))
def panel_top_hosts(spark, folder):
    return P.top_terms(log_events(spark, folder), "source_host", 10)


@query("panel_top_users", _top("user_id", 16))
def panel_top_users(spark, folder):
    return P.top_terms(log_events(spark, folder), "user_id", 16)


@query(
    "panel_top_severity",
    f"""SELECT 'term' AS kind, term, n FROM (SELECT (['emergency','alert','critical','error','warning','notice','informational','debug'])[(CASE WHEN event_id % 50 = 0 THEN 13 ELSE {L.PRI} END) % 8 + 1] AS term, count(*) AS n
    FROM events GROUP BY ALL) ORDER BY n DESC, term LIMIT 10""",
)
def panel_top_severity(spark, folder):
    return P.top_terms(syslog.parse_syslog(L.syslog_lines(spark, folder)), "syslog_severity", 10)


@query("panel_top_programs", _top(L.PROGRAM, 10, where="event_id % 50 <> 0"))
def panel_top_programs(spark, folder):
    return P.top_terms(syslog.parse_syslog(L.syslog_lines(spark, folder)), "syslog_program", 10)


def _eventlog(spark, folder):
    return windows.normalize_eventlog(L.eventlog_lines(spark, folder))


@query("panel_top_events", _top(L.EVENT_IDS, 10, where=f"NOT ({L.CORRUPT})"))
def panel_top_events(spark, folder):
    return P.top_terms(_eventlog(spark, folder), "EventID", 10)


@query(
    "panel_lockouts",
    _top("('user' || cast(event_id % 20 as varchar))", 10, where=f"event_type = 'error' AND NOT ({L.CORRUPT})"),
)
def panel_lockouts(spark, folder):
    df = _eventlog(spark, folder).filter(S.equals(F.col("EventID"), 4740))
    return P.top_terms(df, "TargetUserName", 10)


@query(
    "panel_top_terms_other_missing",
    """WITH t AS (SELECT CASE WHEN event_id % 7 <> 0 THEN 'u' || cast(user_id as varchar) END AS term FROM events),
    c AS (SELECT term, count(*) AS n FROM t GROUP BY term), p AS (SELECT * FROM c WHERE term IS NOT NULL AND term NOT IN ('u1', 'u2')),
    top AS (SELECT * FROM p ORDER BY n DESC, term LIMIT 10)
    SELECT 'term' AS kind, term, n FROM top UNION ALL SELECT 'other', NULL, cast((SELECT sum(n) FROM p) - (SELECT sum(n) FROM top) as bigint)
    UNION ALL SELECT 'missing', NULL, cast((SELECT sum(n) FROM c WHERE term IS NULL) as bigint)""",
)
def panel_top_terms_other_missing(spark, folder):
    df = table(spark, folder, "events").select(F.expr("CASE WHEN event_id % 7 <> 0 THEN 'u' || cast(user_id as string) END").alias("who"))
    return P.top_terms(df, "who", 10, exclude=["u1", "u2"], missing=True, other=True)


_WORDS = "(SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS term FROM {})"


def _words(spark, folder, name):
    words = F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return table(spark, folder, name).select(F.explode(words).alias("term"))


@query(
    "panel_frequent_words",
    f"""WITH c AS (SELECT term, count(*) AS n FROM {_WORDS.format('documents')} WHERE term NOT IN ('the', 'The') GROUP BY term),
    top AS (SELECT * FROM c ORDER BY n DESC, term LIMIT 20)
    SELECT 'term' AS kind, term, n FROM top
    UNION ALL SELECT 'other', NULL, cast((SELECT sum(n) FROM c) - (SELECT sum(n) FROM top) as bigint)""",
)
def panel_frequent_words(spark, folder):
    """The words of whole texts: as many terms as the texts have different words."""
    return frequent_terms(_words(spark, folder, "documents"), "term", 20, exclude=["the", "The"], other=True)


@query("panel_frequent_parts", _top("l_partkey", 10, "lineitem"))
def panel_frequent_parts(spark, folder):
    return frequent_terms(table(spark, folder, "lineitem"), "l_partkey", 10)


@query(
    "panel_terms_stats",
    f"""SELECT {HOST} AS term, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(sum(value), 4) AS total
    FROM events GROUP BY ALL ORDER BY sum(value) DESC, term LIMIT 5""",
)
def panel_terms_stats(spark, folder):
    df = P.terms_stats(log_events(spark, folder), "source_host", "value", "total", 5)
    return df.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


@query(
    "panel_stats",
    f"""WITH {_SERIES} SELECT series, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, round(stddev_samp(value), 6) AS std_deviation FROM series GROUP BY ALL""",
)
def panel_stats(spark, folder):
    df = P.stats(S.by_query(log_events(spark, folder), S.pick(named_queries())), "value")
    return df.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4), "std_deviation": F.round("std_deviation", 6)})


@query(
    "panel_trends",
    f"""WITH {_SERIES}, m AS (SELECT max(ts) AS t FROM events) SELECT series, count(*) FILTER (ts > t - INTERVAL '7 days') AS this_period,
    count(*) FILTER (ts <= t - INTERVAL '7 days') AS previous_period,
    round((count(*) FILTER (ts > t - INTERVAL '7 days') - count(*) FILTER (ts <= t - INTERVAL '7 days')) * 100.0 / count(*) FILTER (ts <= t - INTERVAL '7 days'), 6) AS change_percent
    FROM series, m WHERE ts > t - INTERVAL '14 days' GROUP BY ALL""",
)
def panel_trends(spark, folder):
    df = log_events(spark, folder)
    as_of = latest(df, "event_ts")
    out = P.trends(S.by_query(df, S.pick(named_queries())), as_of, dt.timedelta(days=7))
    return out.withColumn("change_percent", F.round("change_percent", 6).cast("double"))


@query(
    "panel_goal",
    "SELECT count(*) AS n, cast(5000 as bigint) AS target, round(count(*) * 100.0 / 5000, 6) AS percent FROM events WHERE event_type = 'purchase'",
)
def panel_goal(spark, folder):
    df = P.goal(log_events(spark, folder).filter(S.equals(F.col("program"), "purchase")), 5000)
    return df.withColumn("percent", F.round("percent", 6).cast("double"))


@query(
    "panel_geo_map",
    "SELECT 'C' || cast(n_nationkey as varchar) AS country, count(*) AS n FROM events JOIN nation ON user_id % 30 = n_nationkey GROUP BY ALL",
)
def panel_geo_map(spark, folder):
    return P.geo_map(geo_events(spark, folder))


@query(
    "panel_geo_grid",
    """SELECT cast(floor((n_nationkey * 11 - 130) / 20.0) * 20 as double) AS lon_cell, cast(floor((n_nationkey * 7 - 90) / 20.0) * 20 as double) AS lat_cell, count(*) AS n
    FROM events JOIN nation ON user_id % 30 = n_nationkey GROUP BY ALL""",
)
def panel_geo_grid(spark, folder):
    return P.geo_grid(geo_events(spark, folder), 20.0)


@query(
    "panel_events_table",
    f"""SELECT strftime(ts, '{SECOND}') AS event_second, {HOST} AS source_host, substr(event_type || ' by user ' || cast(user_id as varchar), 1, 12) AS msg, event_id
    FROM events ORDER BY ts DESC, event_id DESC LIMIT 500 OFFSET 100""",
)
def panel_events_table(spark, folder):
    df = log_events(spark, folder).withColumns(
        {"msg": F.expr("program || ' by user ' || cast(user_id as string)"), "event_second": second("event_ts")}
    )
    return P.events_table(df, ["event_second", "source_host", "msg", "event_id"], "event_id", offset=100, trim={"msg": 12})


#: Fields of a record: those of every line, those that the written records have, those that they leave out.
_EVERY = ["type", "host", "received_at", "ingest_seq", "tags", "json_ok", "event_ts"]
_RECORD = [
    "msg", "EventType", "FileName", "source_host", "eventlog_severity", "eventlog_severity_code", "EventReceivedTime", "eventlog_channel",
    "eventlog_program", "nxlog_input", "SourceModuleType", "eventlog_category", "EventID", "eventlog_record_number", "eventlog_pid", "UserID",
    "SubjectUserName", "TargetUserName", "flat_message", "extra", "eventlog_id",
]
_LEFT_OUT = ["EventTime", "EventTimeWritten"]


@query(
    "field_presence",
    f"""WITH c AS (SELECT count(*) AS whole, count(*) FILTER (NOT ({L.CORRUPT})) AS good, count(*) FILTER (NOT ({L.CORRUPT}) AND event_type = 'error') AS errors FROM events)
    SELECT unnest({_EVERY}) AS field, whole AS n FROM c UNION ALL SELECT unnest({_RECORD}), good FROM c
    UNION ALL SELECT unnest({_LEFT_OUT}), 0 FROM c UNION ALL SELECT 'errorCode', errors FROM c""",
)
def field_presence(spark, folder):
    return P.field_presence(_eventlog(spark, folder))


# --- dashboards ---------------------------------------------------------------
def _panel_sql(hist_width: str, hits: list[tuple[str, str]], charted: str, terms: list[tuple[str, str, int, str]], source: str, span: str, as_of: str = "m") -> str:
    parts = [f"SELECT 'hits' AS panel, '{a}' AS series, cast(NULL as varchar) AS key, count(*) AS n FROM s WHERE {w} HAVING count(*) > 0" for a, w in hits]
    low, high = (f"time_bucket(INTERVAL '{hist_width}', {t})" for t in (f"{as_of} - INTERVAL '{span}'", as_of))
    parts.append(
        f"SELECT 'histogram', '{charted}', strftime(b, '{SECOND}'), cast(sum(n) as bigint) FROM (SELECT time_bucket(INTERVAL '{hist_width}', ts) AS b, count(*) AS n FROM s GROUP BY ALL "
        f"UNION ALL SELECT unnest(generate_series({low}, {high}, INTERVAL '{hist_width}')), 0 FROM (SELECT max(ts) AS m FROM events)) GROUP BY ALL"
    )
    for panel, field, size, where in terms:
        title = panel.replace("'", "''")
        parts.append(
            f"SELECT * FROM (SELECT '{title}', cast(NULL as varchar), cast({field} as varchar) AS key, count(*) AS n FROM s WHERE {where} AND {field} IS NOT NULL GROUP BY ALL ORDER BY n DESC, key LIMIT {size})"
        )
    return f"WITH s AS ({source}) " + " UNION ALL ".join(parts)


_SEVERITY = f"(['emergency','alert','critical','error','warning','notice','informational','debug'])[(CASE WHEN event_id % 50 = 0 THEN 13 ELSE {L.PRI} END) % 8 + 1]"
_OK = "event_id % 50 <> 0"


# A syslog line carries whole seconds, so the range starts at a whole second too.
CENTRAL_SQL = _panel_sql(
    "5 minutes",
    [("all", "true"), ("Invalid User", f"event_type = 'view' AND {_OK}"), ("Failed Password", f"event_type = 'error' AND {_OK}")],
    "all",
    [
        ("Syslog Severities", _SEVERITY, 10, "true"),
        ("Syslog Program", f"(CASE WHEN {_OK} THEN {L.PROGRAM} END)", 10, "true"),
        ("Top 10 Sources", f"(CASE WHEN {_OK} THEN {HOST} ELSE 'relay' END)", 10, "true"),
    ],
    "SELECT * FROM events, (SELECT max(ts) AS m FROM events) WHERE date_trunc('second', ts) >= date_trunc('second', m) - INTERVAL '12 hours'",
    "12 hours",
    "date_trunc('second', m)",
)


@query("dashboard_central", CENTRAL_SQL)
def dashboard_central(spark, folder):
    """Raw syslog lines to the central dashboard's panels."""
    as_of = latest(table(spark, folder, "events"), "ts").replace(microsecond=0)
    raw = L.syslog_lines(spark, folder)
    raw = raw.filter(S.arrived_since(F.col("received_at"), as_of, CENTRAL.span))
    raw = raw.withColumn("received_at", F.date_trunc("second", "received_at"))
    df = syslog.parse_syslog(raw.withColumn("tags", tags_by_type(F.col("type"), F.col("tags"))))
    return CENTRAL.panels(df, as_of)


_WINDOWS_SOURCE = (
    "SELECT * FROM events, (SELECT max(ts) AS m FROM events) WHERE (CASE WHEN {c} THEN ts ELSE date_trunc('second', ts) END) "
    ">= m - INTERVAL '24 hours'"
).format(c=L.CORRUPT)
_GOOD = f"NOT ({L.CORRUPT})"


def _windows_dashboard(board, spark, folder):
    as_of = latest(table(spark, folder, "events"), "ts")
    raw = L.eventlog_lines(spark, folder)
    raw = raw.filter(S.arrived_since(F.col("received_at"), as_of, board.span))
    return board.panels(windows.normalize_eventlog(raw), as_of)


@query(
    "dashboard_windows",
    _panel_sql(
        "10 minutes",
        [("all", "true")],
        "all",
        [
            ("Top Host's", HOST, 10, _GOOD),
            ("Top Event Categories", "event_type", 10, _GOOD),
            ("Top Event Severities", f"lower({L.SEVERITY_NAME})", 10, _GOOD),
            ("Top Event UserID's", "('S-1-5-' || cast(user_id % 12 as varchar))", 10, _GOOD),
            ("Top Event Logs", L.CHANNEL, 10, _GOOD),
            ("Top Error Codes", "(CASE WHEN event_type = 'error' THEN '0x18' END)", 10, _GOOD),
        ],
        _WINDOWS_SOURCE,
        "24 hours",
    ),
)
def dashboard_windows(spark, folder):
    return _windows_dashboard(WINDOWS, spark, folder)


@query(
    "dashboard_lockouts",
    _panel_sql(
        "10 minutes",
        [("Lockouts", f"event_type = 'error' AND {_GOOD}"), ("all", "true")],
        "all",
        [
            ("Common Events", L.EVENT_IDS, 10, _GOOD),
            ("Most Active DCs", HOST, 16, _GOOD),
            ("Most Locked Out", "('user' || cast(event_id % 20 as varchar))", 10, f"{_GOOD} AND event_type = 'error'"),
        ],
        _WINDOWS_SOURCE,
        "24 hours",
    ),
)
def dashboard_lockouts(spark, folder):
    return _windows_dashboard(LOCKOUTS, spark, folder)
