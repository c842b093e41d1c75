"""Dimension joins: location by address range, host inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalar import ipv4_number
from timberline.functions.tags import add_tags

# The fields of a location record.
GEO_TEXT = [
    "city_name", "continent_code", "country_code2", "country_code3", "country_name",
    "postal_code", "region_name", "time_zone",
]


def dimension_join(
    df: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    also: Column | None = None,
    salts: int = 0,
) -> DataFrame:
    """Left join with a dimension.

    Spark broadcasts the dimension if it is small in bytes, and otherwise shuffles both sides and
    splits the skewed partitions it meets.  For hot keys where it cannot re-plan (streams), ``salts``
    spreads each key over that many groups: facts by the task that read them, the
    dimension by copies, and facts without a key the same way.
    """
    side, on = dim, list(keys)
    if salts:
        df = df.withColumn("_salt", F.spark_partition_id() % salts)
        side = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = [*keys, "_salt"]
    left, right = df.alias("l"), side.alias("r")
    condition = also if also is not None else F.lit(True)
    for k in on:
        condition = (F.col(f"l.{k}") == F.col(f"r.{k}")) & condition
    kept = [F.col(f"l.`{c}`") for c in df.columns if c != "_salt"]
    added = [F.col(f"r.`{c}`") for c in dim.columns if c not in keys]
    return left.join(right, condition, "left").select(*kept, *added)


def geo_enrich(df: DataFrame, ip: str, blocks: DataFrame, **join_options: int) -> DataFrame:
    """Add ``geoip`` (with ``coordinates`` [lon, lat]) and the tag ``geoip``.

    ``blocks`` holds disjoint ranges start_ip..end_ip and a ``geoip`` struct.  Each range
    is cut at /16 borders, so the range lookup becomes an equi-join on the upper
    half of the address plus a bounds check.  No match leaves ``geoip`` NULL.
    """
    geo = F.col("geoip")
    for name in GEO_TEXT:
        geo = geo.withField(name, F.nullif(F.col(f"geoip.{name}"), F.lit("")))
    for name in ("longitude", "latitude"):
        geo = geo.withField(name, F.col(f"geoip.{name}").try_cast("double"))
    coordinates = F.when(
        geo["longitude"].isNotNull() & geo["latitude"].isNotNull(), F.array(geo["longitude"], geo["latitude"])
    )
    pieces = blocks.select(
        F.explode(F.sequence(F.floor(F.col("start_ip") / 65536), F.floor(F.col("end_ip") / 65536))).alias("_prefix"),
        F.col("start_ip").alias("_from"),
        F.col("end_ip").alias("_to"),
        geo.withField("coordinates", coordinates).alias("geoip"),
    )
    df = df.withColumn("_ip", ipv4_number(F.col(ip))).withColumn("_prefix", F.floor(F.col("_ip") / 65536))
    inside = F.col("l._ip").between(F.col("r._from"), F.col("r._to"))
    out = dimension_join(df, pieces, ["_prefix"], also=inside, **join_options).drop("_ip", "_prefix", "_from", "_to")
    return out.withColumn("tags", add_tags(F.col("tags"), "geoip", when=F.col("geoip").isNotNull()))


def coords(df: DataFrame) -> DataFrame:
    """The ``coords`` array of events tagged ``geoip``."""
    tagged = F.array_contains("tags", "geoip")
    return df.withColumn("coords", F.when(tagged, F.col("geoip.coordinates")))


def host_resolve(df: DataFrame, host: str, hosts: DataFrame, target: str = "source_host_ip", **join_options: int) -> DataFrame:
    """Address of a host name from the inventory; the name itself when unknown.

    A value already in ``target`` is kept.
    """
    book = hosts.groupBy(F.col("hostname").alias("_host")).agg(F.min("ip").alias("_found"))
    out = dimension_join(df.withColumn("_host", F.col(host)), book, ["_host"], **join_options)
    value = F.coalesce("_found", F.col(host))
    if target in df.columns:
        value = F.coalesce(F.col(target), value)
    return out.withColumn(target, value).drop("_host", "_found")


def host_reverse(df: DataFrame, address: str, hosts: DataFrame, **join_options: int) -> DataFrame:
    """Replace an address by its host name where the inventory has one."""
    book = hosts.groupBy(F.col("ip").alias("_ip")).agg(F.min("hostname").alias("_found"))
    out = dimension_join(df.withColumn("_ip", F.col(address)), book, ["_ip"], **join_options)
    return out.withColumn(address, F.coalesce("_found", F.col(address))).drop("_ip", "_found")
