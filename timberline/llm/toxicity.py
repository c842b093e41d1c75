"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words, and starts of words (4 and 5 letters), that labelled toxic texts
hold far more often than others.  The features of a text are the densities of the lexicon's
words and starts, how near they stand to a word of the second person, its capitals, its
punctuation and how much it disguises words (digits and signs between letters, letters one
by one).  Trees and calibration are learned from different rows.

Learning uses a bounded sample: the ROWS labelled rows with the lowest hashes of their ids, of
texts of at most LONGEST characters.  Every text is scored as a whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import column, forget_others, free_name, memo, prepare, shared_folder, stored

ROWS = 20_000
LONGEST = 50_000
#: A term is toxic if at least LEAST toxic texts hold it, and one in OF of them, at a rate TIMES the rate in others.
LEAST, OF, TIMES = 4, 250, 20
#: Most terms of the lexicon, the most frequent ones first.
TERMS = 5000
TREES, DEPTH = 20, 3
NEAR = 5

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split()
)
#: Signs that stand for letters in disguised words.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "-": None, ".": None, "_": None})

LETTERS = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!*._-]++[^\W\d_]++)+")  # in linear time, for runs of any length
SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
CAPITALS = bytes(range(65, 91))
SMALL = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())

FEATURES = (
    "word_density word_hits start_density start_hits best_hits near_second second_density "
    "capitals capital_words marks questions signs digits disguised disguised_hits spelled size"
).split()


def terms_of(word: str) -> tuple[str, ...]:
    """A word, and its starts, which end in a star."""
    n = len(word)
    return (word,) if n < 5 else (word, word[:4] + "*") if n < 6 else (word, word[:4] + "*", word[:5] + "*")


def features_of(text: str | None, lexicon: frozenset[str], memo: dict[str, int]) -> list[float]:
    """The features of one text; all zero for NULL and texts without content."""
    if not text:
        return [0.0] * len(FEATURES)
    counts = Counter(LETTERS.findall(text))
    n = sum(counts.values())
    words = starts = second = capital = 0
    kinds: dict[str, int] = {}
    for word, times in counts.items():
        kind = memo.get(word)
        if kind is None:
            small = word.lower()
            word_, *starts_ = terms_of(small)
            kind = (word_ in lexicon) + 2 * any(x in lexicon for x in starts_) + 4 * (small in SECOND_PERSON) + 8 * (len(word) > 1 and word.isupper())
            if len(memo) > 500_000:
                memo.clear()  # it only saves time
            memo[word] = kind
        if kind:
            kinds[word] = kind
            words += times * (kind & 1)
            starts += times * (kind >> 1 & 1)
            second += times * (kind >> 2 & 1)
            capital += times * (kind >> 3)
    near = 0.0
    if second and (words or starts):
        places = [(i, kinds.get(w, 0)) for i, w in enumerate(LETTERS.findall(text))]
        hits = np.array([i for i, k in places if k & 3])
        them = np.array([i for i, k in places if k & 4])
        at = np.searchsorted(them, hits)
        gap = np.minimum(np.abs(hits - them[np.maximum(at - 1, 0)]), np.abs(hits - them[np.minimum(at, len(them) - 1)]))
        near = float((gap <= NEAR).mean())
    raw = text.encode()
    size = len(raw)

    def share(kind: bytes) -> float:
        return (size - len(raw.translate(None, kind))) / size

    disguised = DISGUISED.findall(text)
    spelled = SPELLED.findall(text)
    plain = [x.lower().translate(STAND_INS) for x in disguised] + [re.sub(r"[ .*_-]", "", x).lower() for x in spelled]
    caught = sum(any(t in lexicon for t in terms_of(x)) for x in plain)
    letters = share(CAPITALS) + share(SMALL)
    m = max(n, 1)
    return [
        words / m, float(words), starts / m, float(starts), float(max(words, starts)), near, second / m,
        share(CAPITALS) / letters if letters else 0.0, capital / m, text.count("!") / size, text.count("?") / size,
        share(SIGNS), share(DIGITS), len(disguised) / m, float(caught), len(spelled) / m, float(np.log1p(n)),
    ]


_WORKER = memo()


def with_features(docs: DataFrame, lexicon: list[str], name: str) -> DataFrame:
    """All columns of `docs` and an array of the features of its text."""
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(frozenset(lexicon)), uuid.uuid4().hex

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(_WORKER)
        if _WORKER.get("key") != key:
            _WORKER.update(key=key, memo={})
        for batch in batches:
            rows = [features_of(x, shared.value, _WORKER["memo"]) for x in column(batch, "text").cast(pa.string()).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Terms that toxic rows (text, toxic) hold far more often than others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list(seen[0] | seen[1])
            parts = [pa.array([c[t] for t in terms], pa.int64()) for c in seen]
            seen[0].clear(), seen[1].clear()
            return pa.record_batch([pa.array(terms, pa.string()), *parts], ["term", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist()):
                seen[toxic].update({t for w in set(LETTERS.findall(text.lower())) for t in terms_of(w)})
            if len(seen[0]) + len(seen[1]) > 1_000_000:
                yield out()
        yield out()

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    terms = rows.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long")
    terms = terms.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = (F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1) / ((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    found = terms.where((F.col("toxic") >= max(LEAST, sizes.get(1, 0) // OF)) & (rate >= TIMES))
    return [r["term"] for r in found.orderBy(F.col("toxic").desc(), "term").limit(TERMS).collect()]


class Model:
    """A lexicon, trees and a calibration, or one constant where the labels leave nothing to learn."""

    def __init__(self, lexicon: list[str], trees=None, calibration=None, constant: float = 0.0) -> None:
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` and score (0 to 1), predicted (1 if score >= 0.5) of each row, empty and NULL texts too."""
        keep = [c for c in keep if c.lower() not in ("score", "predicted")]
        rows = docs.select(*dict.fromkeys([*keep, "text"]))
        if self.trees is None:
            scored = rows.withColumn("score", F.lit(float(self.constant)))
        else:
            made = {x: free_name(rows, x) for x in ("features", "_raw", "_share", "_guess", "_margin", "_calibrated")}
            rows = with_features(rows, self.lexicon, made["features"]).drop(*({"text"} - set(keep)))
            rows = rows.withColumn(made["features"], array_to_vector(made["features"]))
            self.trees.setFeaturesCol(made["features"]).setRawPredictionCol(made["_raw"])
            self.trees.setProbabilityCol(made["_share"]).setPredictionCol(made["_guess"])
            self.calibration.setFeaturesCol(made["_margin"]).setPredictionCol(made["_calibrated"])
            rows = self.trees.transform(rows).withColumn(made["_margin"], vector_to_array(made["_share"])[1])
            limited = F.least(F.greatest(F.col(made["_calibrated"]), F.lit(0.0)), F.lit(1.0))
            scored = self.calibration.transform(rows).withColumn("score", limited)
        return scored.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> Model:
    """Learn from `labels` (doc_id, toxic 0 or 1) and the texts of those documents.

    NULL labels and texts, and labelled texts of over `longest` characters, are left out.  Of several labels
    of a document each counts.  Seven tenths of the sample give the lexicon and the trees, the rest the calibration;
    where one of the two lacks a label, all rows serve for both.
    """
    spark = prepare(docs.sparkSession)
    shared_folder(spark)  # the trees are checkpointed there
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "toxic").limit(rows)
    whole = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest))
    whole = whole.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stored(whole.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "h"), "toxic")  # at most `rows` ids
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model([], constant=float(max(sizes, default=0)))
    sample = sample.withColumn("part", F.pmod("h", F.lit(10)))
    train, rest = sample.where("part < 7"), sample.where("part >= 7")
    if train.agg(F.countDistinct("toxic")).first()[0] < 2 or rest.agg(F.countDistinct("toxic")).first()[0] < 2:
        train = rest = sample
    lexicon = learn_lexicon(train)
    names = {"train": train, "rest": rest}
    both = [with_features(rows, lexicon, "features").select("features", "toxic", F.lit(n).alias("of")) for n, rows in names.items()]
    table = stored(both[0].unionByName(both[1]), "toxic-features")
    table = table.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), "of")
    train, rest = table.where("of = 'train'"), table.where("of = 'rest'")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.2, seed=7, minInstancesPerNode=2).fit(train.coalesce(8))
    margins = trees.transform(rest).select(vector_to_array("probability")[1].alias("features"), "label")
    return Model(lexicon, trees, IsotonicRegression().fit(margins))
