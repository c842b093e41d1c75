"""Dashboard panels: histograms, top terms, statistics, event tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions.search import NamedQuery, by_query

# The interval menu, as seconds.
INTERVALS = {
    "1s": 1,
    "1m": 60,
    "5m": 300,
    "10m": 600,
    "30m": 1800,
    "1h": 3600,
    "3h": 10800,
    "12h": 43200,
    "1d": 86400,
    "1w": 604800,
    "1M": 2592000,
    "1y": 31536000,
}
_CALENDAR = {"1w": "week", "1M": "month", "1y": "year"}


def bucket(ts: Column, interval: str) -> Column:
    """Start of the bucket; weeks, months and years follow the calendar."""
    if interval in _CALENDAR:
        return F.date_trunc(_CALENDAR[interval], ts)
    width = INTERVALS[interval]
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / width) * width)


def auto_interval(span: dt.timedelta, resolution: int = 100) -> str:
    """The menu interval closest to ``span / resolution``."""
    wanted = span.total_seconds() / resolution
    return min(INTERVALS, key=lambda name: abs(INTERVALS[name] - wanted))


def histogram(df: DataFrame, interval: str, series: str = "series", ts: str = "event_ts") -> DataFrame:
    """Events per bucket and series.

    On a stream the buckets are windows, which keep the watermark, so that closed buckets leave
    the state; weeks, months and years are for tables only.
    """
    if df.isStreaming:
        if interval in _CALENDAR:
            raise ValueError(f"no live buckets of {interval}")
        width = F.window(ts, f"{INTERVALS[interval]} seconds")
        return df.groupBy(series, width.alias("w")).agg(F.count("*").alias("n")).select(series, F.col("w.start").alias("bucket"), "n")
    return df.groupBy(series, bucket(F.col(ts), interval).alias("bucket")).agg(F.count("*").alias("n"))


# What a histogram can show of a field, per bucket.
MODES = {"count": F.count, "min": F.min, "mean": F.avg, "max": F.max, "total": F.sum}


def value_histogram(
    df: DataFrame,
    interval: str,
    value: str,
    modes: Sequence[str] = ("mean",),
    scale: float = 1,
    series: str = "series",
    ts: str = "event_ts",
) -> DataFrame:
    """Statistics of a field per bucket and series, times ``scale``, one column per mode."""
    shown = [(MODES[m](value) * scale).alias(m) for m in modes]
    return df.groupBy(series, bucket(F.col(ts), interval).alias("bucket")).agg(*shown)


def zero_grid(spark: SparkSession, start: dt.datetime, end: dt.datetime, interval: str, names: Sequence[str]) -> DataFrame:
    """series, bucket and the count 0 for every bucket of a range and every series."""
    first, last = (bucket(F.lit(t).cast("timestamp"), interval) for t in (start, end))
    shortest = {"1M": 28 * 86400, "1y": 365 * 86400}.get(interval, INTERVALS[interval])
    steps = int(max((end - start).total_seconds(), 0) // shortest) + 2
    if interval == "1M":
        bucket_at = first + F.make_interval(months=F.col("id").cast("int"))
    elif interval == "1y":
        bucket_at = first + F.make_interval(years=F.col("id").cast("int"))
    else:
        bucket_at = F.timestamp_seconds(F.unix_seconds(first) + F.col("id") * INTERVALS[interval])
    return (
        spark.range(steps + 1)  # rows, not one array, so that a long range is spread over tasks
        .select(F.explode(F.array(*[F.lit(n) for n in names])).alias("series"), bucket_at.alias("bucket"))
        .filter(F.col("bucket") <= last)
        .withColumn("n", F.lit(0).cast("bigint"))
    )


def zero_fill(counts: DataFrame, start: dt.datetime, end: dt.datetime, interval: str, names: Sequence[str]) -> DataFrame:
    """Every bucket of the visible range for every series, absent ones as 0.

    The grid is added to the counts and summed, which needs no join.
    """
    grid = zero_grid(counts.sparkSession, start, end, interval, names)
    both = counts.select("series", "bucket", "n").unionByName(grid)
    return both.groupBy("series", "bucket").agg(F.sum("n").alias("n"))


def derivative(counts: DataFrame) -> DataFrame:
    """Change against the bucket before, per series."""
    w = Window.partitionBy("series").orderBy("bucket")
    return counts.withColumn("change", F.col("n") - F.lag("n").over(w))


def percent(counts: DataFrame) -> DataFrame:
    """Share of each series in its bucket."""
    total = F.sum("n").over(Window.partitionBy("bucket"))
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def cumulative(counts: DataFrame, order: Sequence[str]) -> DataFrame:
    """Stacked running total inside each bucket, in query order."""
    rank = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("series"))
    w = Window.partitionBy("bucket").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("stacked", F.sum("n").over(w))


def hits(df: DataFrame, series: str = "series") -> DataFrame:
    return df.groupBy(series).agg(F.count("*").alias("n"))


def top_terms(
    df: DataFrame,
    field: str,
    size: int = 10,
    order: str = "count",
    exclude: Sequence[str] = (),
    missing: bool = False,
    other: bool = False,
) -> DataFrame:
    """The ``size`` most frequent values (``kind`` = term), ties by value.

    ``other`` adds the events beyond them and ``missing`` the events without a
    value.  ``order`` is count, reverse_count, term or reverse_term.
    """
    term = F.col(field).cast("string")
    excluded = term.isin(*exclude) if exclude else F.lit(False)
    kind = F.when(term.isNull(), 0).when(excluded, 1).otherwise(2)
    # As an aggregate, the kind cannot be pushed below the count: all uses share one shuffle.
    counts = df.groupBy(term.alias("term")).agg(F.count("*").alias("n"), F.max(kind).alias("_kind"))
    present = counts.filter(F.col("_kind") == 2)
    sort = {
        "count": [F.desc("n"), F.asc("term")],
        "reverse_count": [F.asc("n"), F.asc("term")],
        "term": [F.asc("term")],
        "reverse_term": [F.desc("term")],
    }[order]
    top = present.orderBy(*sort).limit(size).select(F.lit("term").alias("kind"), "term", "n")

    def total(rows: DataFrame, name: str) -> DataFrame:
        n = F.coalesce(F.sum("n"), F.lit(0)).alias("n")
        return rows.agg(n).select(F.lit(name).alias("kind"), F.lit(None).cast("string").alias("term"), "n")

    out = top
    if other:
        beyond = present.select("n").unionByName(top.select((-F.col("n")).alias("n")))
        out = out.unionByName(total(beyond, "other"))
    if missing:
        out = out.unionByName(total(counts.filter(F.col("_kind") == 0), "missing"))
    return out


def terms_stats(df: DataFrame, field: str, value: str, stat: str = "total", size: int = 10) -> DataFrame:
    """Per value of ``field``: statistics of ``value``, ordered by one of them."""
    v = F.col(value)
    return (
        df.filter(F.col(field).isNotNull())
        .groupBy(F.col(field).cast("string").alias("term"))
        .agg(
            F.count(v).alias("count"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.avg(v).alias("mean"),
            F.sum(v).alias("total"),
        )
        .orderBy(F.desc(stat), F.asc("term"))
        .limit(size)
    )


def stats(df: DataFrame, value: str, series: str = "series") -> DataFrame:
    v = F.col(value)
    return df.groupBy(series).agg(
        F.count(v).alias("count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.sum(v).alias("total"),
        F.stddev_samp(v).alias("std_deviation"),
    )


def events_table(
    df: DataFrame,
    fields: Sequence[str],
    tie: str,
    ts: str = "event_ts",
    size: int = 100,
    pages: int = 5,
    offset: int = 0,
    trim: Mapping[str, int] | None = None,
) -> DataFrame:
    """The latest ``size * pages`` events; long texts are cut for display."""
    trim = trim or {}
    shown = [F.substring(f, 1, trim[f]).alias(f) if f in trim else F.col(f) for f in fields]
    return df.orderBy(F.desc(ts), F.desc(tie)).offset(offset).limit(size * pages).select(*shown)


def trends(
    df: DataFrame, as_of: dt.datetime, span: dt.timedelta, series: str = "series", ts: str = "event_ts"
) -> DataFrame:
    """Hits in the last period, the one before, and the change in percent."""
    t, middle, first = F.col(ts), as_of - span, as_of - 2 * span
    now = t > F.lit(middle)
    return (
        df.filter((t > F.lit(first)) & (t <= F.lit(as_of)))
        .groupBy(series)
        .agg(F.count_if(now).alias("this_period"), F.count_if(~now).alias("previous_period"))
        .withColumn(
            "change_percent",
            F.when(
                F.col("previous_period") > 0,
                (F.col("this_period") - F.col("previous_period")) * 100.0 / F.col("previous_period"),
            ),
        )
    )


def goal(df: DataFrame, target: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(
        "n", F.lit(target).cast("bigint").alias("target"), (F.col("n") * 100.0 / target).alias("percent")
    )


def geo_map(df: DataFrame, country: str = "geoip.country_code2") -> DataFrame:
    return df.filter(F.col(country).isNotNull()).groupBy(F.col(country).alias("country")).agg(F.count("*").alias("n"))


def geo_grid(df: DataFrame, degrees: float = 10.0, geo: str = "geoip") -> DataFrame:
    """Events per longitude and latitude cell."""
    cell = [F.floor(F.col(f"{geo}.{c}") / degrees) * degrees for c in ("longitude", "latitude")]
    return (
        df.filter(F.col(f"{geo}.longitude").isNotNull() & F.col(f"{geo}.latitude").isNotNull())
        .groupBy(cell[0].alias("lon_cell"), cell[1].alias("lat_cell"))
        .agg(F.count("*").alias("n"))
    )


def sparklines(df: DataFrame, queries: Sequence[NamedQuery], interval: str, ts: str = "event_ts") -> DataFrame:
    """Per query, its bucket counts in time order as one array."""
    counts = histogram(by_query(df, queries), interval, ts=ts)
    line = F.array_sort(F.collect_list(F.struct("bucket", "n")))
    return counts.groupBy("series").agg(line.alias("points"))


def field_presence(df: DataFrame) -> DataFrame:
    """How many events have each field, in one pass."""
    names = df.columns
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{i}").alias("n")) for i, c in enumerate(names)])
    return counted.select(F.inline(pairs))


def _cell(panel: str, series: str | None, key: Column) -> Column:
    return F.struct(
        F.lit(panel).alias("panel"), F.lit(series).cast("string").alias("series"), key.cast("string").alias("key")
    )


def _cells(by_alias: Mapping[str, Column], terms: Mapping[str, tuple[str, int, Sequence[str]]]) -> list[Column]:
    """The cells of hits and top-N panels in which an event counts; NULL for those where it does not."""
    cells = [F.when(condition, _cell("hits", alias, F.lit(None))) for alias, condition in by_alias.items()]
    for panel, (field, _, aliases) in terms.items():
        shown = reduce(or_, [by_alias[a] for a in aliases])
        cells.append(F.when(shown & F.col(field).isNotNull(), _cell(panel, None, F.col(field))))
    return cells


def _bundle(
    cells: DataFrame,
    terms: Mapping[str, tuple[str, int, Sequence[str]]],
    charted: Sequence[str],
    interval: str,
    span: tuple[dt.datetime, dt.datetime] | None,
) -> DataFrame:
    """Panels of the cells (panel, series, key, n): sums, the first rows of top-N panels, zeros where nothing happened."""
    if span is not None:
        grid = zero_grid(cells.sparkSession, *span, interval, charted)
        at = F.unix_seconds("bucket").cast("string").alias("key")
        cells = cells.unionByName(grid.select(F.lit("histogram").alias("panel"), "series", at, "n"))
    size = F.lit(0)
    for panel, (_, n, _) in terms.items():
        size = F.when(F.col("panel") == panel, F.lit(n)).otherwise(size)
    # As an aggregate, the mark cannot be pushed below the count: both uses share one shuffle.
    is_term = F.max(F.col("panel").isin(*terms)).alias("_ranked")
    counts = cells.groupBy("panel", "series", "key").agg(F.sum("n").alias("n"), is_term)
    ranked = F.col("_ranked")
    rank = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("n"), F.asc("key")))
    largest = max((n for _, n, _ in terms.values()), default=0)
    top = counts.filter(ranked).withColumn("_rank", rank).filter(F.col("_rank") <= largest)
    top = top.filter(F.col("_rank") <= size).drop("_rank")
    out = counts.filter(~ranked).unionByName(top).drop("_ranked")
    # Times are formatted here, once per bucket, and not once per event.
    time = F.date_format(F.timestamp_seconds(F.col("key").try_cast("bigint")), "yyyy-MM-dd HH:mm:ss")
    return out.withColumn("key", F.when(F.col("panel") == "histogram", time).otherwise(F.col("key")))


def panel_bundle(
    df: DataFrame,
    queries: Sequence[NamedQuery],
    charted: Sequence[str],
    interval: str,
    terms: Mapping[str, tuple[str, int, Sequence[str]]],
    ts: str = "event_ts",
    span: tuple[dt.datetime, dt.datetime] | None = None,
) -> DataFrame:
    """All counting panels of a dashboard from one scan and one shuffle.

    Each event is expanded to its (panel, series, key) cells and counted once;
    the expansion is narrowed by the map-side partial count.  Top-N panels keep
    their first rows by rank, which Spark limits per task before it shuffles.
    ``charted`` are the histogram's queries, ``terms`` the top-N panels as
    title -> (field, size, queries).  With ``span`` the histogram has all buckets
    of that range.  Columns: panel, series, key, n.
    """
    start = F.unix_seconds(bucket(F.col(ts), interval))
    by_alias = {q.alias: q.condition for q in queries if q.enabled}
    cells = _cells(by_alias, terms)
    cells += [F.when(by_alias[alias], _cell("histogram", alias, start)) for alias in charted if alias in by_alias]
    expanded = df.select(F.explode(F.array(*cells)).alias("c")).filter(F.col("c").isNotNull()).select("c.*")
    shown = [alias for alias in charted if alias in by_alias]
    return _bundle(expanded.withColumn("n", F.lit(1).cast("bigint")), terms, shown, interval, span)


def panel_partials(
    df: DataFrame,
    queries: Sequence[NamedQuery],
    terms: Mapping[str, tuple[str, int, Sequence[str]]],
    width: str = "5m",
    ts: str = "event_ts",
) -> DataFrame:
    """Counts per panel, series, key and bucket of ``width``, which add up over batches and buckets.

    ``panels_of`` makes the panels of any range of whole buckets from them.  Events without a time have no bucket.
    """
    cells = _cells({q.alias: q.condition for q in queries if q.enabled}, terms)
    timed = df.filter(F.col(ts).isNotNull()).select(bucket(F.col(ts), width).alias("bucket"), F.explode(F.array(*cells)).alias("c"))
    return summed(timed.filter(F.col("c").isNotNull()).select("c.*", "bucket", F.lit(1).cast("bigint").alias("n")))


def summed(partials: DataFrame) -> DataFrame:
    """Partial counts of the same cell and bucket as one row."""
    return partials.groupBy("panel", "series", "key", "bucket").agg(F.sum("n").alias("n"))


def panels_of(
    partials: DataFrame,
    charted: Sequence[str],
    interval: str,
    terms: Mapping[str, tuple[str, int, Sequence[str]]],
    span: tuple[dt.datetime, dt.datetime] | None = None,
) -> DataFrame:
    """What ``panel_bundle`` gives for the events that the partial counts stand for.

    The histogram comes from the hits; buckets of ``interval`` are whole numbers of kept ones.
    """
    hit = F.struct("panel", "series", "key")
    at = F.unix_seconds(bucket(F.col("bucket"), interval)).cast("string")
    charts = (F.col("panel") == "hits") & F.col("series").isin(*charted)
    chart = F.struct(F.lit("histogram").alias("panel"), "series", at.alias("key"))
    both = F.when(charts, F.array(hit, chart)).otherwise(F.array(hit))
    return _bundle(partials.select(F.explode(both).alias("c"), "n").select("c.*", "n"), terms, charted, interval, span)
