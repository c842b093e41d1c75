"""Registered queries: each runs over whole given tables, most with a SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} is registered twice")

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return run(prepare(spark), folder)

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(run: Query) -> Query:
        register(name, run, sql)
        return run

    return wrap


def load() -> None:
    from timberline.suite import parsing, searching, storing, streams  # noqa: F401
