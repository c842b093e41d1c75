"""Compare registered queries with their SQL on DuckDB.

Run as a script: ``python tests/compare.py [scale [query ...]]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _value(v: object) -> str:
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else f"{v:.9g}"
    return f"{type(v).__name__}:{v}"


def rows_of(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql: str, folder: str) -> str:
    """An empty text when equal, else what differs."""
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    want = relation.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}; only ours {sorted(set(a) - set(b))[:2]}; only theirs {sorted(set(b) - set(a))[:2]}"
    if not a:
        return "no rows"
    if a != b:
        cols, ours, theirs = sorted(names), sorted(set(a) - set(b)), sorted(set(b) - set(a))
        x = ours[0]
        y = max(theirs, key=lambda r: sum(p == q for p, q in zip(x, r)))  # the row most like ours
        cells = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
        return f"{len(ours)} rows differ, for example {cells}"
    return ""


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{scale}"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, failed = make_session(), connect(folder), 0
    for name in names:
        began = time.time()
        try:
            problem = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.2f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
