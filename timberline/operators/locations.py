"""Longest-prefix location of IPv4 and IPv6 addresses, by equality alone.

Addresses are 128-bit numbers in two bigints, ``hi`` and ``lo``; IPv4 lies in ::ffff:0:0/96 (RFC 4291).  A network of
``length`` bits is split to the next multiple of ``STEP`` bits, so that at most 2**(STEP - 1) rows stand
for it and an address has one key for each such level.  Address and network then meet in a hash or merge join,
however many networks lie side by side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.scalar import ipv4_number
from timberline.operators.enrich import dimension_join

STEP = 4
#: Bits before an IPv4 address.
MAPPED = 96
_V4_LO = 0xFFFF << 32


def _bits(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def address(text: Column) -> Column:
    """``hi`` and ``lo`` of an address as text; NULL for anything else.

    IPv6 may be shortened (``::``), end in an IPv4 address and carry a zone (``%eth0``), which is left out.
    """

    def either(t: Column) -> Column:
        v6 = F.when(t.contains(":"), _let(F.regexp_replace(t, "^([0-9a-f:.]+)%[^%/]+$", "$1"), lambda u: _let(_hexadecimal(u), _v6)))
        return F.coalesce(_let(ipv4_number(t), lambda n: F.when(n.isNotNull(), _bits(F.lit(0), n + _V4_LO))), v6)

    return _let(F.lower(F.trim(text)), either)


def _hexadecimal(text: Column) -> Column:
    """The text with an IPv4 address at its end as two groups; NULL for other dots."""
    tail = ipv4_number(F.nullif(F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1), F.lit("")))

    def groups(n: Column) -> Column:
        ends = [F.lower(F.hex(part.bitwiseAND(F.lit(0xFFFF)))) for part in (F.shiftright(n, 16), n)]
        return F.when(n.isNotNull(), F.concat(F.regexp_replace(text, r"[^:]*$", ""), F.concat_ws(":", *ends)))

    return F.when(~text.contains("."), text).otherwise(_let(tail, groups))


def _v6(text: Column) -> Column:
    """The bits of hexadecimal groups, of which ``::`` stands for all that are left out."""

    def numbers(digits: Column) -> Column:
        return F.when(digits.isNotNull(), _bits(*[F.conv(F.substring(digits, at, 16), 16, -10) for at in (1, 17)]))

    def padded(groups: Column) -> Column:
        right = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(right, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    def filled(sides: Column) -> Column:
        # 9 groups, which are too many, where nothing is left out
        given = F.size(sides[0]) + F.size(sides[1])
        return F.concat(sides[0], F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(1))), sides[1])

    def side(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def halves(h: Column) -> Column:
        short = _let(F.array(side(F.get(h, F.lit(0))), side(F.get(h, F.lit(1)))), filled)
        return F.when(F.size(h) == 2, short).when(F.size(h) == 1, F.split(text, ":"))

    return _let(_let(_let(F.split(text, "::"), halves), padded), numbers)


def _cut(bits: Column, length: Column) -> Column:
    """The first ``length`` bits, the others 0."""
    ones = F.lit(-1).cast("bigint")

    def mask(n: Column) -> Column:
        return F.when(n <= 0, F.lit(0).cast("bigint")).when(n >= 64, ones).otherwise(F.call_function("shiftleft", ones, (64 - n).cast("int")))

    return _bits(bits["hi"].bitwiseAND(mask(length)), bits["lo"].bitwiseAND(mask(length - 64)))


def networks(df: DataFrame, cidr: str, value: str) -> DataFrame:
    """``bits``, ``length`` and ``value`` of networks written ``address/length``; rows that are none are left out.

    Bits beyond the length are ignored; an address without a length is a network of its own.
    """
    parts = F.split(F.trim(F.col(f"`{cidr}`")), "/")
    bits = address(F.get(parts, F.lit(0)))
    before = F.when(F.get(parts, F.lit(0)).contains(":"), 0).otherwise(MAPPED)
    length = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.when(F.size(parts) == 1, 128 - before)) + before
    rows = df.select(
        F.explode(F.array(bits)).alias("bits"), length.alias("length"), F.col(f"`{value}`").alias("value"), before.alias("before"), F.size(parts).alias("parts")
    )
    valid = F.col("bits").isNotNull() & F.col("length").between(F.col("before"), 128) & (F.col("parts") <= 2)
    return rows.where(valid).select("bits", "length", "value")


def range_networks(df: DataFrame, start: str, end: str, value: str) -> DataFrame:
    """The fewest networks that make up each range of IPv4 numbers (``start`` to ``end``, both included).

    Between the numbers just outside the range, a network begins at each 0 bit of the lower and each 1
    bit of the upper one, below the highest bit in which they differ.  Empty ranges have none.
    """
    room = 1 << 32  # keeps the number before 0 positive
    below, above = (F.col(f"`{start}`").cast("bigint") + (room - 1), F.col(f"`{end}`").cast("bigint") + (room + 1))

    def piece(bit: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
        differ = F.call_function("shiftright", F.col("below").bitwiseXOR(F.col("above")), bit + 1) > 0

        def begun(number: Column, wanted: int) -> Column:
            # the number with this bit turned and the lower ones 0
            turned = F.call_function("shiftleft", F.call_function("shiftright", number, bit).bitwiseXOR(F.lit(1).cast("bigint")), bit)
            has = F.call_function("shiftright", number, bit).bitwiseAND(F.lit(1).cast("bigint")) == wanted
            return F.when(differ & has & (size > 0), F.struct((turned - room).alias("at"), (32 - bit).alias("length")))

        return F.array(begun(F.col("below"), 0), begun(F.col("above"), 1))

    rows = df.select(below.alias("below"), above.alias("above"), F.col(f"`{value}`").alias("value"))
    rows = rows.where((F.col("above") - F.col("below") >= 2) & (F.col("below") >= room - 1) & (F.col("above") <= 2 * room))
    bits = F.sequence(F.lit(0), F.lit(32))
    rows = rows.select(F.explode(F.filter(F.flatten(F.transform(bits, piece)), lambda p: p.isNotNull())).alias("p"), "value")
    return rows.select(_bits(F.lit(0), F.col("p.at") + _V4_LO).alias("bits"), (F.col("p.length") + MAPPED).alias("length"), "value")


def _levels(nets: DataFrame) -> DataFrame:
    """One row for each level and prefix: the value of the longest network there; of one network twice, the smaller value."""
    one = nets.groupBy(_cut(F.col("bits"), F.col("length")).alias("bits"), "length").agg(F.min("value").alias("value"))
    level = (F.ceil(F.col("length") / STEP) * STEP).cast("int")
    rows = one.withColumn("level", level).withColumn("i", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, level - length) - 1"))))
    moved = F.expr("shiftleft(cast(i AS bigint), CASE WHEN level <= 64 THEN 64 - level ELSE 128 - level END)")
    hi, lo = F.col("bits.hi"), F.col("bits.lo")
    rows = rows.select(
        "level", "length", "value",
        F.when(F.col("level") <= 64, hi.bitwiseOR(moved)).otherwise(hi).alias("hi"),
        F.when(F.col("level") <= 64, lo).otherwise(lo.bitwiseOR(moved)).alias("lo"),
    )
    return rows.groupBy("level", "hi", "lo").agg(F.max_by("value", "length").alias("value"))


def locate(df: DataFrame, ip: str, nets: DataFrame, target: str, salts: int = 0) -> DataFrame:
    """Add ``target``: the value of the longest network that holds the address; NULL without one.

    ``nets`` has ``bits``, ``length``, ``value`` (``networks``, ``range_networks`` or both); networks may lie in each
    other.  Each different address is looked up once, so a busy one costs nothing in the lookup; ``salts`` spreads
    it over tasks where the found values come back (see ``dimension_join``).  A ``target`` that exists is replaced.
    """
    levels = _levels(nets)
    used = levels.agg(F.array_sort(F.collect_set("level")).alias("used")).scalar()
    rows = df.select(F.col(f"`{ip}`").alias("_ip")).where(F.col("_ip").isNotNull()).distinct()
    # exploded, as Spark would repeat the parsing in each filter otherwise
    rows = rows.select("_ip", F.explode(F.array(address(F.col("_ip")))).alias("bits")).where(F.col("bits").isNotNull())
    is_v4 = (F.col("bits.hi") == 0) & (F.shiftrightunsigned("bits.lo", 32) == 0xFFFF)
    rows = rows.withColumn("level", F.explode(used)).where((F.col("level") >= MAPPED) | ~is_v4)
    cut = _cut(F.col("bits"), F.col("level"))
    keyed = rows.select("_ip", "level", cut["hi"].alias("hi"), cut["lo"].alias("lo"))
    found = keyed.join(levels, ["level", "hi", "lo"]).groupBy("_ip").agg(F.max_by("value", "level").alias("_found"))
    kept = df.drop(target) if target in df.columns and target != ip else df
    out = dimension_join(kept.withColumn("_ip", F.col(f"`{ip}`")), found, ["_ip"], salts=salts)
    return out.withColumn(target, F.col("_found")).drop("_ip", "_found")
