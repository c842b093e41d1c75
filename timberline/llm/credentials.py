"""Secret scans by multipart credential linking, in DataFrame functions alone.

Some texts are secrets by their form: assignments of a long value, access keys, long hexadecimal
runs.  Others are only parts of a credential: a login name, a short value, an opaque token, an
address of a service.  Those weak candidates are reported where the parts that complete them stand
in the same scope (a passage without a blank line), at most REACH code points away.

Places come from the pieces that a pattern's matches leave of a text: the lengths of pieces and
matches add up to where each match stands.  What is left of a text is a few numbers a match, written
once; texts are not shuffled.  Parts are joined as intervals: each enters every cell of REACH
code points that it touches with its reach, parts that share a cell are compared.  Parts of a
kind do not overlap, so a cell holds a bounded number of them, however large the table, its groups of copies or
a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import prepare, stored

#: Code points between parts of one credential, at most.
REACH = 200


def either(words: str) -> str:
    """A pattern for words in either case of the letters A-Z, the same in every regular-expression dialect."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
# The base patterns.
ASSIGN = f"({either('password|passwd|secret|token|api_?key')}){_SET}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LONG_VALUE, LONG_ACCESS, LONG_HEX = 12, 18, 16
#: The patterns of weak parts.
LOGIN = f"({either('username|user|login|client_?id|key_?id')}){_SET}([A-Za-z0-9_.@-]+)"
OPAQUE = "[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""[a-z]{2,12}://[^\x00-\x20"'<>]+"""
SHORT_VALUE = 4
BLANK_LINE = r"\n[\x20\t\r]*\n"


@dataclass(frozen=True)
class Part:
    """A kind of span: its pattern, the tests of a match (group 2: `v`, whole match: `m`), and its role."""

    kind: str
    pattern: str
    test: str
    role: str
    base: bool


#: In the order of the report.  Patterns whose short matches fail in any case are written with a least length.
PARTS = [
    Part("assign", ASSIGN, f"length(v) >= {LONG_VALUE}", "secret", True),
    Part("access", ACCESS, f"length(m) >= {LONG_ACCESS}", "identity", True),
    Part("hex", HEX.replace("+", f"{{{LONG_HEX},}}"), "true", "secret", True),
    Part("short", ASSIGN, f"length(v) >= {SHORT_VALUE} AND length(v) < {LONG_VALUE}", "secret", False),
    Part("opaque", OPAQUE, "m RLIKE '[a-z]' AND m RLIKE '[A-Z]' AND m RLIKE '[0-9]'", "secret", False),
    Part("login", LOGIN, "true", "identity", False),
    Part("endpoint", ENDPOINT, "true", "endpoint", False),
]
KINDS = [p.kind for p in PARTS]
BASE = [p.kind for p in PARTS if p.base]
BREAK = "break"

#: What completes a weak part; near_x says that a part of kind or role x is in reach.
COMPLETE = {
    "short": "near_access OR (near_login AND near_endpoint)",
    "opaque": "NOT covered AND (near_access OR (near_login AND near_endpoint))",
    "login": "near_endpoint AND near_secret",
    "endpoint": "near_secret AND (near_access OR near_login)",
}


def _found(text: Column, pattern: str, group: int | None) -> Column:
    """Lengths of the pieces before matches, matches, and values (a group); NULL where nothing matches."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    return F.when(text.rlike(pattern), F.struct(gaps.alias("gaps"), whole.alias("m"), value.alias("v")))


def marks(docs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (key, row), and the places (row, kind, at, stop, m) of all parts and of blank lines in rows that hold a weak part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pairs = {"assign": (ASSIGN, 2), **{p.kind: (p.pattern, 2 if p.kind == "login" else None) for p in PARTS if p.kind not in ("assign", "short")}}
    found = docs.select(*key, F.monotonically_increasing_id().alias("row"), *(_found(text, *x).alias(f"_{k}") for k, x in pairs.items()), text.alias("_text"))
    weak = F.coalesce(*(F.col(f"_{p.kind}.m") for p in PARTS if not p.base and p.kind != "short"), F.col("_assign.m")).isNotNull()
    breaks = F.when(weak, _found(F.col("_text"), BLANK_LINE, None)).alias(f"_{BREAK}")
    rows = stored(found.select(*key, "row", *(f"_{k}" for k in pairs), breaks), "marks")
    kinds = [*pairs, BREAK]
    each = rows.select("row", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("x")) for k in kinds))).alias("e"))
    each = each.where("e.x IS NOT NULL").select("row", "e.kind", F.posexplode(F.arrays_zip("e.x.gaps", "e.x.m", "e.x.v")).alias("i", "z"))
    each = each.select("row", "kind", "i", F.col("z.gaps").alias("gap"), F.col("z.m").alias("m"), F.col("z.v").alias("v"))
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    stop = F.sum(F.col("gap").cast("long") + F.coalesce(F.length("m"), F.lit(0))).over(so_far)
    placed = each.withColumn("stop", stop).where("m IS NOT NULL").withColumn("at", F.col("stop") - F.length("m"))
    tests = F.array_compact(F.array(*(F.when((F.col("kind") == ("assign" if p.kind == "short" else p.kind)) & F.expr(p.test), F.lit(p.kind)) for p in PARTS), F.when(F.col("kind") == BREAK, F.lit(BREAK))))
    return rows.select(*key, "row"), placed.select("row", F.explode(tests).alias("kind"), "at", "stop", "m")


def link(placed: DataFrame) -> DataFrame:
    """The weak parts (row, kind, at, stop, m) that other parts complete."""
    roles = F.create_map(*(F.lit(x) for p in PARTS for x in (p.kind, p.role)))
    by_row = Window.partitionBy("row")
    weak = F.max(F.col("kind").isin(*COMPLETE)).over(by_row)
    scope = F.count_if(F.col("kind") == BREAK).over(by_row.orderBy("at", "stop"))
    parts = placed.select("*", weak.alias("some")).where("some").select("row", "kind", "at", "stop", "m", scope.alias("scope"))
    parts = parts.where(F.col("kind") != BREAK).withColumn("role", roles[F.col("kind")])
    parts = stored(parts, "parts")
    cell = lambda x: F.floor(x / F.lit(REACH))
    left = parts.where(F.col("kind").isin(*COMPLETE)).withColumn("cell", F.explode(F.sequence(cell(F.col("at")), cell(F.col("stop")))))
    right = parts.select("row", "scope", F.col("kind").alias("k"), F.col("role").alias("r"), F.col("at").alias("a"), F.col("stop").alias("s"))
    right = right.withColumn("cell", F.explode(F.sequence(cell(F.col("a") - REACH), cell(F.col("s") + REACH))))
    near = left.join(right, ["row", "scope", "cell"]).where((F.col("a") <= F.col("stop") + REACH) & (F.col("at") <= F.col("s") + REACH))
    found = near.groupBy("row", "kind", "at", "stop", "m").agg(
        *(F.max(F.col("k") == k).alias(f"near_{k}") for k in ("access", "login")),
        *(F.max(F.col("r") == r).alias(f"near_{r}") for r in ("endpoint", "secret")),
        F.max(F.col("k").isin(*BASE) & (F.col("a") < F.col("stop")) & (F.col("at") < F.col("s"))).alias("covered"),
    )
    whole = F.coalesce(*(F.when(F.col("kind") == k, F.expr(x)) for k, x in COMPLETE.items()))
    return found.where(whole).select("row", "kind", "at", "stop", "m")


def credentials(docs: DataFrame, key: list[str] = ["doc_id"]) -> DataFrame:
    """The key columns and `spans`: kind, at, stop (code points, end exclusive) and text of all secrets of each row.

    Spans come by place, then in the order of KINDS; the base kinds are always there, weak ones where
    other parts complete them.  NULL texts are empty and have no spans; repeated rows and ids are rows of
    their own; other columns do not matter.
    """
    prepare(docs.sparkSession)
    rows, placed = marks(docs.select(*key, "text"), key)
    placed = stored(placed, "places")
    base = placed.where(F.col("kind").isin(*BASE)).select("row", "kind", "at", "stop", "m")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("at", order.alias("o"), "kind", "stop", F.col("m").alias("text"))
    spans = base.unionByName(link(placed)).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = rows.join(spans, "row", "left")
    fields = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["at"].alias("at"), x["stop"].alias("stop"), x["text"].alias("text")))
    return out.select(*key, F.coalesce(fields, F.array().cast(fields_type())).alias("spans"))


def fields_type() -> str:
    return "array<struct<kind:string,at:bigint,stop:bigint,text:string>>"


def digest(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["stop"].cast("string"))), ",")


def report(docs: DataFrame, key: list[str] = ["doc_id"]) -> DataFrame:
    """Numbers of the base kinds, a hash of the base spans, and all spans, without the secrets themselves."""
    out = credentials(docs, key)
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = of(*BASE)
    return out.select(*key, *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
