"""Exact top terms of a field with millions of values, without a count of each.

Terms are hashed to two rows of cells, and the events of a cell are counted: what a task sends is
bounded by the cells, however many terms there are, and the counts of tasks, days or buckets add up.
No term has more events than either of its cells.  The terms in the fullest cells are counted
exactly; if ``size`` of them have at least t events, a term with less than t in one of its cells is not
among the top, and only the others are counted.  Where terms are so even that no cell can be ruled
out, this is the full count; the result is exact in any case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a row.  A field's top terms are told apart once they have more events than a cell has on average.
CELLS = 1 << 14
#: Fullest cells that are counted term by term for each wanted term, to find t.
GUESSES = 4
_MISSING, _EXCLUDED = -1, -2


def _places(term: Column, cells: int) -> list[Column]:
    """The cell in each row; the rows use different bits of the hash."""
    digest = F.xxhash64(term)
    return [F.pmod(digest, F.lit(cells)), F.pmod(F.shiftrightunsigned(digest, 32), F.lit(cells)) + cells]


def cell_counts(df: DataFrame, field: str, exclude: Sequence[str] = (), by: Sequence[str] = (), cells: int = CELLS) -> DataFrame:
    """``cell`` and its events ``n``, for each value of ``by``, such as a day; sums over ``by`` are the counts of all.

    Each event counts in a cell of both rows (from 0 and from ``cells``); events without a value are in
    cell -1, those of ``exclude`` in cell -2.
    """
    term = F.col(f"`{field}`").cast("string")
    excluded = term.isin(*exclude) if exclude else F.lit(False)
    where = F.when(term.isNull(), F.array(F.lit(_MISSING).cast("bigint")))
    where = where.when(excluded, F.array(F.lit(_EXCLUDED).cast("bigint"))).otherwise(F.array(*_places(term, cells)))
    return df.select(*by, F.explode(where).alias("cell")).groupBy(*by, "cell").agg(F.count("*").alias("n"))


def frequent_terms(
    df: DataFrame,
    field: str,
    size: int = 10,
    exclude: Sequence[str] = (),
    missing: bool = False,
    other: bool = False,
    counts: DataFrame | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """As ``panels.top_terms`` in the order ``count``: kind, term, n; ties by value.

    The field is read three times, so a field that is costly to make should be stored before.
    ``counts`` are cell counts of the same rows that were kept (``cell_counts`` with the same ``exclude`` and ``cells``,
    per day or bucket as well); the first of the three reads is left out then.  Empty texts are terms;
    an empty table has no terms, and 0 as ``other`` and ``missing``.
    """
    if counts is None:
        counts = cell_counts(df, field, exclude, cells=cells)
    # As an aggregate, the cell cannot be pushed below the count: all uses share one shuffle.
    counts = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("cell").alias("at"))
    term = F.col(f"`{field}`").cast("string")
    places = [p.alias(f"place_{i}") for i, p in enumerate(_places(term, cells))]
    events = df.where(term.isNotNull()).select(term.alias("term"), *places)
    if exclude:
        events = events.where(~F.col("term").isin(*exclude))

    def inside(rows: DataFrame, some: DataFrame, place: str) -> DataFrame:
        # at most one row a cell, whatever the data
        return rows.join(F.broadcast(some.select(F.col("at").alias(place))), place, "left_semi")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("term").agg(F.count("*").alias("n"))

    first = counts.where(F.col("at").between(0, cells - 1))
    fullest = first.orderBy(F.desc("n"), F.asc("at")).limit(GUESSES * size)
    best = counted(inside(events, fullest, "place_0")).select("n").orderBy(F.desc("n")).limit(size)
    least = best.agg(F.when(F.count("*") == size, F.min("n")).otherwise(F.lit(0)).alias("t")).scalar()
    open_cells = counts.where(F.col("n") >= least)
    for i in (0, 1):
        events = inside(events, open_cells.where(F.col("at").between(i * cells, (i + 1) * cells - 1)), f"place_{i}")
    top = counted(events).orderBy(F.desc("n"), F.asc("term")).limit(size).select(F.lit("term").alias("kind"), "term", "n")

    def total(rows: DataFrame, name: str) -> DataFrame:
        n = F.coalesce(F.sum("n"), F.lit(0)).alias("n")
        return rows.agg(n).select(F.lit(name).alias("kind"), F.lit(None).cast("string").alias("term"), "n")

    out = top
    if other:
        out = out.unionByName(total(first.select("n").unionByName(top.select((-F.col("n")).alias("n"))), "other"))
    if missing:
        out = out.unionByName(total(counts.where(F.col("at") == _MISSING), "missing"))
    return out
