"""The three shipped dashboards as data: queries, filters, panels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.search import TIME_RANGES, NamedQuery, equals, everything, phrase, since
from timberline.functions.tags import has_tag
from timberline.operators.panels import auto_interval, events_table, panel_bundle, panel_partials, panels_of


@dataclass(frozen=True)
class Dashboard:
    """``terms`` maps a panel title to its field, size and queries."""

    span: str
    queries: Callable[[], list[NamedQuery]]
    must: Callable[[], Column]
    histogram: list[str]
    terms: dict[str, tuple[str, int, list[str]]]
    fields: list[str]
    trim: dict[str, int]
    refresh: str = "5 minutes"

    @property
    def interval(self) -> str:
        return auto_interval(TIME_RANGES[self.span])

    def scope(self, df: DataFrame, as_of: dt.datetime) -> DataFrame:
        return df.filter(since(F.col("event_ts"), as_of, self.span) & self.must())

    def panels(self, df: DataFrame, as_of: dt.datetime) -> DataFrame:
        """Histogram with its empty buckets, hits and top terms, from one scan."""
        return panel_bundle(self.scope(df, as_of), self.queries(), self.histogram, self.interval, self.terms, span=self.range(as_of))

    def range(self, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
        return as_of - TIME_RANGES[self.span], as_of

    def partials(self, df: DataFrame, width: str) -> DataFrame:
        """The counts of all panels per bucket of ``width``."""
        return panel_partials(df.filter(self.must()), self.queries(), self.terms, width)

    def panels_of(self, partials: DataFrame, as_of: dt.datetime) -> DataFrame:
        """The panels from partial counts of the buckets in range."""
        return panels_of(partials, self.histogram, self.interval, self.terms, self.range(as_of))

    def table(self, df: DataFrame, as_of: dt.datetime, tie: str = "ingest_seq") -> DataFrame:
        """The latest events."""
        return events_table(self.scope(df, as_of), self.fields, tie, trim=self.trim)


# What the dashboards show.
CENTRAL = Dashboard(
    span="12h",
    queries=lambda: [
        NamedQuery("all", everything()),
        NamedQuery("Invalid User", phrase(F.col("msg"), "Invalid user"), pinned=True),
        NamedQuery("Failed Password", phrase(F.col("msg"), "Failed password"), pinned=True),
    ],
    must=lambda: has_tag(F.col("tags"), "syslog"),
    histogram=["all"],
    terms={
        "Syslog Severities": ("syslog_severity", 10, ["all"]),
        "Syslog Program": ("syslog_program", 10, ["all"]),
        "Top 10 Sources": ("source_host", 10, ["all"]),
    },
    fields=["event_ts", "source_host", "msg", "syslog_severity", "syslog_facility", "tags"],
    trim={"msg": 300},
)
WINDOWS = Dashboard(
    span="24h",
    queries=lambda: [NamedQuery("all", everything())],
    must=lambda: equals(F.col("type"), "eventlog"),
    histogram=["all"],
    terms={
        "Top Host's": ("source_host", 10, ["all"]),
        "Top Event Categories": ("eventlog_category", 10, ["all"]),
        "Top Event Severities": ("eventlog_severity", 10, ["all"]),
        "Top Event UserID's": ("UserID", 10, ["all"]),
        "Top Event Logs": ("eventlog_channel", 10, ["all"]),
        "Top Error Codes": ("errorCode", 10, ["all"]),
    },
    fields=[
        "event_ts", "source_host", "msg", "eventlog_category", "eventlog_program", "eventlog_severity", "UserID", "tags",
    ],
    trim={"msg": 300},
)
LOCKOUTS = Dashboard(
    span="24h",
    queries=lambda: [
        NamedQuery("Lockouts", equals(F.col("EventID"), 4740), pinned=True),
        NamedQuery("all", everything()),
    ],
    must=everything,
    histogram=["all"],
    terms={
        "Common Events": ("EventID", 10, ["all"]),
        "Most Active DCs": ("source_host", 16, ["all"]),
        "Most Locked Out": ("TargetUserName", 10, ["Lockouts"]),
    },
    fields=[
        "EventTime", "eventlog_channel", "EventID", "eventlog_program", "flat_message", "SubjectUserName", "TargetUserName",
    ],
    trim={"flat_message": 550},
)
