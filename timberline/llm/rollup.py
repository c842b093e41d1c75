"""Token counts as delta-maintained totals by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) is turned into signed rows, summed per
key and written to a folder of its own; then one row in the list of commits names that folder.
The totals are the sums over the folders that are committed, so nothing is ever updated in
place and no total is read to change it.

A batch counts once: a batch id that is committed is skipped, what a failed attempt has written
is named by no commit, and of two commits of one batch, as two drivers may make at once, the one
with the smaller folder name counts.  `compact` sums the committed folders up to one, which
replaces them by the same rule.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import prepare

KEYS = ["source", "lang", "tokenizer"]
COMMIT = "batch string, folder string, replaces array<string>"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes (op, source, lang, tokenizer, n_tokens, old_tokens) as signed rows.

    `insert` adds a document and its tokens, `delete` takes them off, `revise` adds the new count
    and takes the old one off.  NULL counts are 0; NULL keys are keys of their own.  A row with
    another op is an error, not a change that gets lost.
    """
    n, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("n_tokens", "old_tokens"))
    op = F.col("op")
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("NULL"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(unknown.cast("int"))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
    return changes.select(*(F.col(k).cast("string").alias(k) for k in KEYS), docs.cast("long").alias("n_docs"), tokens.alias("n_tokens"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """The totals under one path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = prepare(spark), path.rstrip("/")

    def _commits(self) -> dict[str, tuple[str, list[str]]]:
        """Folder and replaced batches of each committed batch; one row a batch, few after `compact`."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        out: dict[str, tuple[str, list[str]]] = {}
        for r in sorted(rows, key=lambda r: (r["batch"], r["folder"])):
            out.setdefault(r["batch"], (r["folder"], r["replaces"] or []))
        return out

    def _live(self) -> dict[str, str]:
        """The batches whose folders make up the totals.

        A compaction counts if all that it replaces counts and no other one has replaced any of it: of two
        that ran at once one is void, whichever, since both hold the sum of what they replace.
        """
        commits = self._commits()
        depth, before = dict.fromkeys(commits, 0), None
        while depth != before:  # compactions come after all that they replace
            before = depth
            depth = {b: max((1 + before[x] for x in replaced if x in before), default=0) for b, (_, replaced) in commits.items()}
        counts: set[str] = set()
        gone: set[str] = set()
        for batch in sorted(commits, key=lambda b: (depth[b], b)):
            replaced = set(commits[batch][1])
            if replaced <= counts and not replaced & gone:
                counts.add(batch)
                gone |= replaced
        return {batch: commits[batch][0] for batch in counts - gone}

    def _commit(self, batch: str, rows: DataFrame, replaces: list[str]) -> None:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        self.spark.createDataFrame([(batch, folder, replaces)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if this batch was there already."""
        if batch in self._commits():
            return False
        self._commit(batch, summed(signed(changes)), [])
        return True

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*(f"{self.path}/data/{x}" for x in sorted(folders)))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches; keys at zero are left out."""
        rows = summed(self._read(list(self._live().values())))
        return rows.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> None:
        """Put the committed batches together; their ids stay known, so that replays are still skipped."""
        live = self._live()
        if len(live) > 1:
            rows = summed(self._read(list(live.values())))  # of these folders alone, whatever came in meanwhile
            self._commit(f"compacted-{uuid.uuid4().hex}", rows.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0)), sorted(live))
