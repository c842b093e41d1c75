"""Search predicates and named queries as boolean columns.

Two notions of a word exist in the event store.  Phrases are matched on the
analysed default field: case-insensitive, between non-word characters.  Single
terms are matched as whole blank-separated tokens, also case-insensitive.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.extract import matches
from timberline.functions.scalar import CLOCK_AHEAD

# The ranges of the time picker.
TIME_RANGES = {
    "5m": dt.timedelta(minutes=5),
    "15m": dt.timedelta(minutes=15),
    "1h": dt.timedelta(hours=1),
    "6h": dt.timedelta(hours=6),
    "12h": dt.timedelta(hours=12),
    "24h": dt.timedelta(hours=24),
    "2d": dt.timedelta(days=2),
    "7d": dt.timedelta(days=7),
    "30d": dt.timedelta(days=30),
}


def everything() -> Column:
    return F.lit(True)


def phrase(field: Column, text: str) -> Column:
    words = r"\W+".join(re.escape(w) for w in text.split())
    return matches(field, rf"(?iuU)(^|\W){words}(\W|$)")


def term(field: Column, text: str) -> Column:
    """A whole token; the cheap ``contains`` spares most rows the split."""
    lowered = F.lower(field)
    token = F.array_contains(F.split(lowered, r"\s+"), text.lower())
    return F.coalesce(lowered.contains(text.lower()) & token, F.lit(False))


def equals(field: Column, value: object) -> Column:
    return F.coalesce(field == F.lit(value), F.lit(False))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def different(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def arrived_since(received_at: Column, as_of: dt.datetime, span: str) -> Column:
    """A filter before parsing that loses no event of the range: a line's own time may be ahead of its arrival."""
    return received_at >= F.lit(as_of - TIME_RANGES[span] - CLOCK_AHEAD)


def since(ts: Column, as_of: dt.datetime, span: str) -> Column:
    """``now-<span> .. now`` with ``now`` as a parameter, so results repeat."""
    start = as_of - TIME_RANGES[span]
    return ts.between(F.lit(start), F.lit(as_of))


@dataclass(frozen=True)
class NamedQuery:
    alias: str
    condition: Column
    pinned: bool = False
    enabled: bool = True


def pick(queries: Sequence[NamedQuery], mode: str = "all", selected: Sequence[str] = ()) -> list[NamedQuery]:
    """The queries a panel shows: ``all``, ``pinned``, ``unpinned`` or ``selected``."""
    keep = {
        "all": lambda q: True,
        "pinned": lambda q: q.pinned,
        "unpinned": lambda q: not q.pinned,
        "selected": lambda q: q.alias in selected,
    }[mode]
    return [q for q in queries if q.enabled and keep(q)]


def by_query(df: DataFrame, queries: Sequence[NamedQuery], name: str = "series") -> DataFrame:
    """One row per event and matching query, from a single scan."""
    hits = F.array(*[F.when(q.condition, F.lit(q.alias)) for q in queries])
    return df.withColumn(name, F.explode(hits)).filter(F.col(name).isNotNull())
