"""Parse quality, device tags, entities and log levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.extract import FAILURE_TAG, matches
from timberline.functions.grammar import block
from timberline.functions.tags import add_tags, has_tag


def device_tags(df: DataFrame, rules: dict[str, str], host: str = "source_host") -> DataFrame:
    """A tag per host-naming regex; the naming scheme is the caller's."""
    tags = F.col("tags")
    for tag, regex in rules.items():
        tags = add_tags(tags, tag, when=matches(F.col(host), regex))
    return df.withColumn("tags", tags)


def mark_unfiltered(df: DataFrame, tag: str = "not_filtered") -> DataFrame:
    """Parsed events that no more specific rule has tagged."""
    plain = ~has_tag(F.col("tags"), FAILURE_TAG)
    return df.withColumn("tags", add_tags(F.col("tags"), tag, when=plain))


def parse_coverage(df: DataFrame) -> DataFrame:
    """Events, failures and failure rate per type."""
    bad = has_tag(F.col("tags"), FAILURE_TAG)
    return (
        df.groupBy("type")
        .agg(F.count("*").alias("n"), F.count_if(bad).alias("failures"))
        .withColumn("failure_percent", F.col("failures") * 100.0 / F.col("n"))
    )


def unmatched_prefixes(df: DataFrame, length: int = 20, size: int = 10) -> DataFrame:
    """The most frequent beginnings of lines no pattern matched, per type."""
    failed = df.filter(has_tag(F.col("tags"), FAILURE_TAG))
    counts = failed.groupBy("type", F.substring("message", 1, length).alias("prefix")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), F.asc("prefix")))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= size)


# Kind -> a sign that must be in the text, and the block to find.
ENTITIES = {"ip": (".", "ipv4"), "uuid": ("-", "uuid"), "url": ("://", "uri"), "user": ("@", "email")}


def entities(df: DataFrame, text: str, kinds: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per address, UUID or URL found in a text, in one scan."""
    kinds = kinds or ENTITIES
    found = []
    for kind, (sign, regex) in kinds.items():
        values = F.regexp_extract_all(F.col(text), F.lit(f"({block(regex)})"), F.lit(1))
        found.append(
            F.struct(F.lit(kind).alias("kind"), F.when(F.col(text).contains(sign), values).alias("values"))
        )
    names = [c for c in df.columns if c != text]
    per_kind = df.select(*names, F.inline(F.array(*found)))
    return per_kind.select(*names, "kind", F.explode("values").alias("value"))


# Spelling in a line -> level.
LEVELS = {
    "warn": "warning", "err": "error", "crit": "critical", "emerg": "emergency",
}


def log_level(df: DataFrame, text: str = "message") -> DataFrame:
    """The first log level word of a line, in its canonical form."""
    word = F.lower(F.regexp_extract(F.col(text), rf"\b({block('loglevel')})\b", 1))
    level = F.nullif(word, F.lit(""))
    for short, name in LEVELS.items():
        level = F.when(word == short, F.lit(name)).otherwise(level)
    return df.withColumn("level", level)
