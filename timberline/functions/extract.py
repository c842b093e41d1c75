"""Turn one text column into many typed fields with one regex pass per row.

``regexp_extract`` runs the whole regex once per field.  Here one
``regexp_replace`` rewrites the line into its fields, joined by a separator, and
one ``split`` cuts them apart, so a 20-field line costs one match and not 20.
All of it stays in generated JVM code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.grammar import LinePattern

SEP = "\u0001"
FAILURE_TAG = "_grokparsefailure"


def clean(source: Column) -> Column:
    """Write the separator character as receiving syslog daemons do (#001)."""
    return F.replace(source, F.lit(SEP), F.lit("#001"))


def layout_of(patterns: Sequence[LinePattern]) -> list[str]:
    return list(dict.fromkeys(f for p in patterns for f in p.fields))


def rewrite(source: Column, patterns: Sequence[LinePattern], layout: Sequence[str] | None = None) -> Column:
    """Replace a line by the fields, in ``layout`` order, of the first pattern that matches.

    The patterns become alternatives of one regex.  Each brings its own search
    prefix, so the first pattern is tried at every position before the second:
    the order of the list decides, not the position in the line.  A line
    that no pattern matches is left as it is.
    """
    layout = layout or layout_of(patterns)
    groups = [g for p in patterns for g in p.groups]
    refs = ["".join(f"${i}" for i, g in enumerate(groups, 1) if g == name) for name in layout]
    # ``(?s:.*)`` and not ``[\s\S]*``, which Java matches ten times slower.
    if len(patterns) == 1 and not patterns[0].at_start:
        regex = patterns[0].regex  # what is in front of the match stays there, as part 0
    else:
        regex = "|".join(p.regex if p.at_start else rf"(?s:.*?)(?:{p.regex})" for p in patterns)
        regex = rf"\A(?:{regex})"
    return F.regexp_replace(source, rf"(?:{regex})(?s:.*)", "".join(SEP + r for r in refs))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    Spark moves filters on a projected column in front of the projection and
    repeats its expression there, which for a large regex means to match every
    line several times.  It does not move filters through ``explode``, here over one element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def part(parts: str, i: int) -> str:
    """SQL for the i-th field of a split line; NULL when empty or not there."""
    return f"nullif(get({parts}, {i}), '')"


def fields_of(
    df: DataFrame,
    rewritten: Column,
    layout: Sequence[str],
    ok: str,
    longs: Sequence[str] = (),
) -> DataFrame:
    """Cut a rewritten line into columns; absent fields and failures are NULL."""
    df = once(df, "_parts", F.split(rewritten, SEP))
    cols = {n: part("_parts", i) for i, n in enumerate(layout, 1)}
    cols[ok] = f"coalesce(size(_parts) = {len(layout) + 1}, false)"
    return df.withColumns(typed(cols, longs)).drop("_parts")


def typed(cols: Mapping[str, str], longs: Sequence[str]) -> dict[str, Column]:
    """Columns of SQL texts; ``longs`` become numbers, NULL where they are none.

    SQL text, as each call into the JVM costs time and a wide line has many fields.
    """
    return {n: F.expr(f"try_cast({sql} as bigint)" if n in longs else sql) for n, sql in cols.items()}


def parse(
    df: DataFrame,
    patterns: LinePattern | Sequence[LinePattern],
    source: str = "message",
    ok: str = "parsed",
    longs: Sequence[str] = (),
    tag: bool | None = None,
    when: Column | None = None,
) -> DataFrame:
    """Add the fields of the first matching pattern, and a boolean ``ok``.

    ``when`` is a cheap test of the lines that can match; the others do not go through the patterns.

    Where ``ok`` is the line's own ``parsed``, and not a test for one kind of line among
    others, a line that no pattern matches is tagged as a failure (``tag`` says otherwise).
    """
    patterns = [patterns] if isinstance(patterns, LinePattern) else list(patterns)
    layout = layout_of(patterns)
    rewritten = rewrite(clean(F.col(source)), patterns, layout)
    df = fields_of(df, rewritten if when is None else F.when(when, rewritten), layout, ok, longs=longs)
    if "tags" in df.columns and (tag if tag is not None else ok == "parsed"):
        tags = F.coalesce("tags", F.array().cast("array<string>"))
        df = df.withColumn("tags", F.when(F.col(ok), F.col("tags")).otherwise(F.array_union(tags, F.array(F.lit(FAILURE_TAG)))))
    return df


def lookup(values: Mapping) -> Column:
    """A constant map, for ``try_element_at``: one lookup in place of a long CASE."""

    def sql(v: object) -> str:
        if isinstance(v, list):
            return f"array({', '.join(map(sql, v))})"
        return quoted(v) if isinstance(v, str) else str(v)

    return F.expr(f"map({', '.join(sql(x) for pair in values.items() for x in pair)})")


def matches(source: Column, regex: str) -> Column:
    return F.coalesce(source.rlike(regex), F.lit(False))
