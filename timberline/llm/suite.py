"""The registered queries of these operators; SQL twins where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The public tokenizer file of the token queries.
TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_token_files")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.token_files import token_files

    return token_files(table(spark, folder, "documents"), tokenizer_path())


#: DuckDB: A-Z to a-z and nothing else.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op10_decontamination",
    rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), sizes AS (SELECT DISTINCT least(13, len(w)) AS n FROM i WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, k, n, item_id FROM doc_windows JOIN item_windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.decontamination import contamination

    rows = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op7_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query(
    "op9_topk",
    """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.topk import top_neighbours

    return top_neighbours(table(spark, folder, "embeddings"))


def digest_mod(column: str, n: int) -> Column:
    """crc32 of a number as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


@query("op1_language")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.language import fit, identify

    docs = table(spark, folder, "documents")
    models = fit(docs.where(digest_mod("doc_id", 3) != 1).select("text", "lang"))
    rows = docs.select("doc_id", (digest_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return identify(rows, models, ["doc_id", "held_out"])


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.toxicity import fit

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit(docs, labels.where(digest_mod("doc_id", 5) != 0))
    return model.score(docs.select("doc_id", (digest_mod("doc_id", 5) == 0).alias("held_out"), "text"), ["doc_id", "held_out"])


MIX_SQL = r"""
d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM docs
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * CAST(source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap
    ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE NOT cap <= level * weight) END AS target,
    CAST(('0x' || substr(md5('mix:' || coalesce('s' || source, '')), 1, 6)) AS BIGINT) / 16777216.0::DOUBLE AS shift FROM l
), ranked AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.digest, d.doc_id) AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), mixed AS (SELECT *, CAST(floor(r * each + shift) - floor((r - 1) * each + shift) AS BIGINT) AS copies FROM ranked)
"""


@query(
    "op2_mixing",
    f"WITH docs AS (SELECT * FROM documents), {MIX_SQL} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.mixing import with_copies, word_count

    docs = table(spark, folder, "documents")
    rows = with_copies(docs, word_count(F.col("text")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query(
    "op6_backoff",
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT doc_id, p, w[p] AS c, CASE WHEN p > 1 THEN w[p - 1] END AS b, CASE WHEN p > 2 THEN w[p - 2] END AS a, len(w) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), n1 AS (SELECT c, count(*) AS k FROM t GROUP BY c), o1 AS (SELECT doc_id, c, count(*) AS k FROM t GROUP BY doc_id, c),
n2 AS (SELECT b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY b, c), o2 AS (SELECT doc_id, b, c, count(*) AS k FROM t WHERE b IS NOT NULL GROUP BY doc_id, b, c),
n3 AS (SELECT a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY a, b, c), o3 AS (SELECT doc_id, a, b, c, count(*) AS k FROM t WHERE a IS NOT NULL GROUP BY doc_id, a, b, c),
total AS (SELECT count(*) AS k FROM t),
u AS (SELECT o1.doc_id, o1.c, n1.k - o1.k AS k FROM o1 JOIN n1 USING (c)),
v AS (SELECT o2.doc_id, o2.b, o2.c, n2.k - o2.k AS k FROM o2 JOIN n2 USING (b, c)),
x AS (SELECT o3.doc_id, o3.a, o3.b, o3.c, n3.k - o3.k AS k FROM o3 JOIN n3 USING (a, b, c)),
s AS (
  SELECT t.doc_id, CASE
    WHEN x.k > 0 THEN ln(x.k / y.k)
    WHEN v.k > 0 THEN ln(v.k / z.k) + ln(0.4) * (least(t.p - 1, 2) - 1)
    ELSE ln(greatest(u.k, 0.5) / greatest(total.k - t.n, 1)) + ln(0.4) * least(t.p - 1, 2) END AS s
  FROM t CROSS JOIN total JOIN u ON u.doc_id = t.doc_id AND u.c = t.c
  LEFT JOIN u z ON z.doc_id = t.doc_id AND z.c = t.b
  LEFT JOIN v ON v.doc_id = t.doc_id AND v.b = t.b AND v.c = t.c
  LEFT JOIN v y ON y.doc_id = t.doc_id AND y.b = t.a AND y.c = t.b
  LEFT JOIN x ON x.doc_id = t.doc_id AND x.a = t.a AND x.b = t.b AND x.c = t.c
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(sum(s), 0), 3) AS log_score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, w
""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.backoff import score

    rows = score(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


SPACE = r"\x20\x09-\x0D"
#: Tokenizer versions of the rollup query: words, words with a letter or digit, and runs of letters, digits or signs.
VERSIONS = {
    "words-1": rf"[^{SPACE}]+",
    "words-2": rf"[^{SPACE}]*[\p{{L}}\p{{N}}][^{SPACE}]*",
    "runs-1": rf"\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+",
}


@query(
    "op3_token_rollup",
    f"""
WITH d AS (
  SELECT doc_id, source, lang, text, {", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS BIGINT) AS n{i}" for i, p in enumerate(VERSIONS.values()))}
  FROM documents
), kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM d) WHERE r = 1 OR text IS NULL)
SELECT source, lang, 'words' AS tokenizer, count(*) AS n_docs, CAST(sum(n1) AS BIGINT) AS n_tokens FROM kept GROUP BY source, lang
UNION ALL
SELECT source, lang, 'runs' AS tokenizer, count(*) AS n_docs, CAST(sum(n2) AS BIGINT) AS n_tokens FROM kept GROUP BY source, lang
""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Four batches over all documents: inserts for two tokenizers, revised counts of one, deletes of exact copies; one is replayed."""
    from timberline.llm.common import new_path, stored
    from timberline.llm.rollup import Rollup

    text = F.coalesce("text", F.lit(""))
    counts = [F.regexp_count(text, F.lit(p)).cast("long").alias(f"n{i}") for i, p in enumerate(VERSIONS.values())]
    digest = F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("digest")
    docs = stored(table(spark, folder, "documents").select("doc_id", "source", "lang", digest, *counts), "counts")
    first = docs.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = docs.join(first, "digest").where(F.col("doc_id") != F.col("first"))

    def changes(rows: DataFrame, op: str, tokenizer: str, count: str, old: str | None = None) -> DataFrame:
        was = F.col(old) if old else F.lit(None).cast("long")
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(count).alias("n_tokens"), was.alias("old_tokens"))

    rollup = Rollup(spark, new_path(spark, "rollup"))
    inserts = changes(docs, "insert", "words", "n0")
    rollup.apply("1-words", inserts)
    rollup.apply("2-runs", changes(docs, "insert", "runs", "n2"))
    rollup.apply("3-revised", changes(docs, "revise", "words", "n1", "n0"))
    rollup.apply("1-words", inserts)
    rollup.apply("4-copies", changes(copies, "delete", "words", "n1").union(changes(copies, "delete", "runs", "n2")))
    return rollup.totals()


@query("op8_chat")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.chat import format_chats

    return format_chats(table(spark, folder, "conversations"))


from timberline.llm import suite_codes  # noqa: E402, F401  registers the remaining queries
