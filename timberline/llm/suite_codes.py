"""Queries of the vector codes, the credential links and the conversation repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import credentials as C
from timberline.llm.suite import query, table


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain search of all entries, one pair of steps a round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id ASC NULLS LAST, q) AS rid, vec_id, label, q FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (
  SELECT rid, part, q[part * (len(q) // {parts}) + 1 : (part + 1) * (len(q) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)
), c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, part, min(best) AS best FROM (
    SELECT p.rid, p.part, {{'gap': CAST(coalesce(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS BIGINT), 'entry': c.entry}} AS best
    FROM p JOIN c{r} c USING (part)) GROUP BY rid, part
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  WITH s AS (
    SELECT part, entry, i, sum(z) AS s, count(*) AS n FROM (
      SELECT part, best.entry AS entry, unnest(x) AS z, generate_subscripts(x, 1) AS i FROM p JOIN a{r} USING (rid, part)) GROUP BY ALL
  ), m AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s GROUP BY ALL)
  SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m USING (part, entry)
)""")
    return f"""WITH {", ".join(steps)}, h AS (
  SELECT sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY part, entry, i)) AS digest
  FROM (SELECT part, entry, unnest(x) AS z, generate_subscripts(x, 1) AS i FROM c{rounds})
), e AS (
  SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.gap) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM v JOIN e USING (rid), h"""


@query("op11_codes", _codes_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.codes import vector_codes

    return vector_codes(table(spark, folder, "embeddings"))


def _secrets_sql() -> str:
    """Every part against every other of its text."""
    quoted = lambda p: p.replace("'", "''")
    found = []
    for part in C.PARTS:
        value = f"regexp_extract_all(text, '{quoted(part.pattern)}', 2)" if part.kind in ("assign", "short") else f"regexp_extract_all(text, '{quoted(part.pattern)}')"
        test = part.test
        for klass in ("[a-z]", "[A-Z]", "[0-9]"):
            test = test.replace(f"m RLIKE '{klass}'", f"regexp_matches(m, '{klass}')")
        found.append((part.kind, part.pattern, value, test))
    found.append((C.BREAK, C.BLANK_LINE, f"regexp_extract_all(text, '{C.BLANK_LINE}')", "true"))
    places = "\nUNION ALL\n".join(
        f"""SELECT row, '{kind}' AS kind, CAST(stop - length(m) AS BIGINT) AS beg, CAST(stop AS BIGINT) AS stop FROM (
  SELECT row, m, v, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY row ORDER BY i) AS stop FROM (
    SELECT row, unnest(g) AS g, unnest(m) AS m, unnest(v) AS v, unnest(range(len(g))) AS i FROM (
      SELECT row, regexp_split_to_array(text, '{quoted(pattern)}') AS g, regexp_extract_all(text, '{quoted(pattern)}') AS m, {value} AS v FROM d)))
WHERE m IS NOT NULL AND {test}"""
        for kind, pattern, value, test in found
    )
    roles = " ".join(f"WHEN '{p.kind}' THEN '{p.role}'" for p in C.PARTS)
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(C.KINDS))
    base = ", ".join(f"'{k}'" for k in C.BASE)
    whole = " OR ".join(f"(kind = '{k}' AND ({x}))" for k, x in C.COMPLETE.items())
    weak = ", ".join(f"'{k}'" for k in C.COMPLETE)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
places AS MATERIALIZED ({places}),
parts AS MATERIALIZED (
  SELECT * FROM (SELECT *, CASE kind {roles} END AS role, CASE kind {order} END AS o, count(*) FILTER (kind = '{C.BREAK}') OVER (PARTITION BY row ORDER BY beg, stop) AS scope FROM places)
  WHERE kind <> '{C.BREAK}'
), near AS (
  SELECT x.row, x.kind, x.beg, x.stop, x.o, bool_or(y.kind = 'access') AS near_access, bool_or(y.kind = 'login') AS near_login, bool_or(y.role = 'endpoint') AS near_endpoint,
    bool_or(y.role = 'secret') AS near_secret, bool_or(y.kind IN ({base}) AND y.beg < x.stop AND x.beg < y.stop) AS covered
  FROM parts x JOIN parts y ON x.row = y.row AND x.scope = y.scope AND y.beg <= x.stop + {C.REACH} AND x.beg <= y.stop + {C.REACH} WHERE x.kind IN ({weak}) GROUP BY ALL
), spans AS (
  SELECT row, kind, beg, stop, o FROM parts WHERE kind IN ({base}) UNION ALL SELECT row, kind, beg, stop, o FROM near WHERE {whole}
), s AS (
  SELECT row, string_agg(kind || ':' || beg || ':' || stop, ',' ORDER BY beg, o) AS spans, string_agg(kind || ':' || beg || ':' || stop, ',' ORDER BY beg, o) FILTER (kind IN ({base})) AS base,
    {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in C.BASE)} FROM spans GROUP BY row
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in C.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (row)"""


@query("op12_credentials", _secrets_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return C.report(table(spark, folder, "documents"))


@query("op13_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from timberline.llm.repair import repair_damaged

    return repair_damaged(table(spark, folder, "conversations"))
