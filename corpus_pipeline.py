"""Documents to token files: language, near duplicates, benchmark passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`.  All but the last return
the columns they were given, whatever further columns and names there are.  The stages are
parted by Parquet tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import free_name, prepare, stored
from timberline.llm.decontamination import contamination
from timberline.llm.language import fit, identify
from timberline.llm.mixing import mix
from timberline.llm.similar import one_of_each
from timberline.llm.suite import table, tokenizer_path
from timberline.llm.token_files import token_files


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language identification rejects: without letters, or in no language of the corpus.

    The models learn from the rows that have a language; without any, no document stays.
    """
    models = fit(docs.select("text", "lang"))
    results = {"lang_pred", "score", "cross_entropy", "accepted"}
    names = {c: f"_kept_{i}" if c.lower() in results else c for i, c in enumerate(docs.columns)}
    rows = identify(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), models)
    return rows.where("accepted").select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8) stays, the one with the smallest doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents.

    Whether a document is contaminated follows from its text, so the digest of the text is its name: no copy of all texts
    is stored to number them, and only the names of the contaminated ones are.  A NULL text has no words and stays.
    """
    digest = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    found = contamination(docs.select(digest.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), ids="string")
    key = free_name(docs, "key")
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(bad, digest == F.col(key), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what they hold: doc_id, start, n_tokens, ids_crc32."""
    return token_files(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Character models, covering tables and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
