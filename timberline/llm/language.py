"""Language identification with interpolated Kneser-Ney character models.

A text is its runs of letters, lower-cased; each run is scored by itself, with a start and an
end sign, so the cross-entropy of a text is the sum over its words divided by its symbols.  One
model of a language holds for each character n-gram its interpolated probability and, for each
context, the mass it gives to shorter ones.  All models share one sorted array of 64-bit
n-gram hashes; a lookup is a binary search, and one search serves all languages.

The language with the lowest cross-entropy is predicted.  From rows that the models have not
seen come the sharpness of the score and, for each language, the cross-entropy above which a text
is rejected: SLACK times the median, and for short texts, whose figure says less, SPREAD standard
deviations, which shrink with the root of the length.  The deviation is taken from the median of
what these rows, whole and cut to the lengths CUTS, stray from the median, so odd rows do not widen it.

Learning uses a bounded sample: at most ROWS different texts a language, chosen by a hash of
the text, of at most LONGEST characters; copies of a text count once.  Every text is predicted as a whole, whatever its length;
runs of over RUN letters are scored in parts of RUN letters.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm.common import column, forget_others, memo, mix64, prepare, stored

ORDER = 4
ROWS = 800
LONGEST = 20_000
RUN = 32
SLACK, SPREAD = 1.5, 8.0
#: Characters to which held-back texts are cut, at the end of a word, to see how short texts stray.
CUTS = (30, 60, 120, 250, 500, 1000)
#: Standard deviations of a normal distribution in a median deviation.
DEVIATION = 1.4826
UNKNOWN = "und"
LETTERS = regex.compile(rf"\p{{L}}{{1,{RUN}}}")
#: Scores that a Python worker remembers, in words times languages.
REMEMBERED = 1_200_000

_FACTORS = mix64((np.arange(16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between the signs 2 and 3, and the place of each inside its word."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    return flat, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def gram_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each place; only places at least n - 1 into a word are valid."""
    out = np.full(len(flat), n, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(n):
            out[back:] += (flat[: len(flat) - back] + np.uint64(1)) * _FACTORS[back]
    return mix64(out)


def train(words: Counter, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the n-grams of one language, log2 probabilities, log2 masses as context.

    Counts of the highest order, and of n-grams at the start of a word, are occurrences; those
    of lower orders are the numbers of different symbols before them.  The discount of an order
    is n1 / (n1 + 2 n2).
    """
    names = list(words)
    flat, place = symbols(names)
    weight = np.repeat(np.array([words[w] for w in names], np.int64), [len(w) + 2 for w in names])
    hashes = [np.zeros(0, np.uint64)] + [gram_hashes(flat, n) for n in range(1, order + 1)]
    keys: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
    probability: list[np.ndarray] = [np.zeros(0)] * (order + 1)
    alphabet = len(np.unique(flat)) + 1
    mass: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in range(1, order + 1):
        at = np.flatnonzero(place >= max(n - 1, 1))  # the start sign is never predicted
        grams, first, inverse = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        if n < order:
            counts = np.zeros(len(grams))
            # different symbols before: different (n+1)-grams by their last n symbols
            longer = np.flatnonzero(place >= n)
            _, one = np.unique(hashes[n + 1][longer], return_index=True)
            np.add.at(counts, np.searchsorted(grams, hashes[n][longer[one]]), 1)
            start = place[at[first]] == n - 1  # nothing stands before these
            raw = np.bincount(inverse, weight[at], len(grams))
            counts = np.where(start, raw, counts)
        else:
            counts = np.bincount(inverse, weight[at], len(grams)).astype(float)
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ends = at[first]
        context = hashes[n - 1][ends - 1] if n > 1 else np.zeros(len(grams), np.uint64)
        contexts, of = np.unique(context, return_inverse=True)
        total = np.bincount(of, counts)
        rest = discount * np.bincount(of) / total
        lower = probability[n - 1][np.searchsorted(keys[n - 1], hashes[n - 1][ends])] if n > 1 else np.full(len(grams), 1 / alphabet)
        keys[n], probability[n] = grams, np.maximum(counts - discount, 0) / total[of] + rest[of] * lower
        mass[n] = contexts, rest
    table: dict[str, np.ndarray] = {"k": np.concatenate(keys[1:]), "p": np.concatenate(probability[1:])}
    contexts = np.concatenate([mass[n][0] for n in range(2, order + 1)])
    rests = np.concatenate([mass[n][1] for n in range(2, order + 1)])
    every = np.unique(np.concatenate([table["k"], contexts]))
    log_p, log_mass = np.full(len(every), np.nan), np.zeros(len(every))
    log_p[np.searchsorted(every, table["k"])] = np.log2(table["p"])
    log_mass[np.searchsorted(every, contexts)] = np.log2(rests)
    # the key 0 holds what an unseen symbol gets: the mass of the empty context over the alphabet
    every, log_p, log_mass = (np.insert(x, 0, y) for x, y in ((every, 0), (log_p, np.log2(mass[1][1][0] / alphabet)), (log_mass, 0)))
    return every, log_p, log_mass


@dataclass
class Models:
    """The models of all languages over one sorted array of hashes."""

    languages: list[str]
    keys: np.ndarray
    log_p: np.ndarray  # a row a key, a column a language; NaN where the language lacks the n-gram
    log_mass: np.ndarray
    sharpness: float = 20.0
    limits: np.ndarray | None = None  # of long texts
    strays: np.ndarray | None = None  # what the limit has more, times the root of the length

    @classmethod
    def join(cls, parts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Models:
        languages = sorted(parts)
        keys = np.unique(np.concatenate([parts[x][0] for x in languages])) if languages else np.zeros(0, np.uint64)
        log_p = np.full((len(keys), len(languages)), np.nan, np.float32)
        log_mass = np.zeros((len(keys), len(languages)), np.float32)
        for i, x in enumerate(languages):
            at = np.searchsorted(keys, parts[x][0])
            log_p[at, i], log_mass[at, i] = parts[x][1], parts[x][2]
        return cls(languages, keys, log_p, log_mass)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def bits(self, words: list[str], order: int = ORDER) -> np.ndarray:
        """Bits that each word costs in each language."""
        flat, place = symbols(words)
        hashes = [gram_hashes(flat, n) for n in range(1, order + 1)]
        total = np.zeros((len(flat), len(self.languages)))
        open_ = np.ones(total.shape, bool)
        open_[place == 0] = False
        for n in range(order, 0, -1):
            at = np.flatnonzero((place >= max(n - 1, 1)) & open_.any(1))
            if not len(at):
                continue
            found = self._find(hashes[n - 1][at])
            value = np.where(found[:, None] >= 0, self.log_p[found], np.nan)
            live = open_[at]
            hit = live & ~np.isnan(value)
            add = np.where(hit, value, 0.0)
            if n > 1:
                context = self._find(hashes[n - 2][at - 1])
                passed = np.where(context[:, None] >= 0, self.log_mass[context], 0.0)
                add += np.where(live & ~hit, passed, 0.0)
            total[at] += add
            open_[at] = live & ~hit
        total += np.where(open_, self.log_p[0], 0.0)
        starts = np.flatnonzero(place == 0)
        return -np.add.reduceat(total, starts, axis=0) if len(starts) else np.zeros((0, len(self.languages)))


_WORKER = memo()


def entropies(models: Models, values: list[str | None], key: object) -> tuple[np.ndarray, np.ndarray]:
    """Bits a symbol of each text in each language, NaN for a text without letters, and its symbols.

    Scores of words are remembered by this Python worker, which only saves time.
    """
    forget_others(_WORKER)
    if _WORKER.get("key") != key:
        _WORKER.update(key=key, places={}, scores=np.zeros((0, len(models.languages)), np.float32))
    out = np.full((len(values), len(models.languages)), np.nan)
    sizes = np.zeros(len(values), np.int64)
    if not models.languages:
        return out, sizes
    if len(_WORKER["places"]) * len(models.languages) > REMEMBERED:
        _WORKER.update(places={}, scores=np.zeros((0, len(models.languages)), np.float32))
    places = _WORKER["places"]
    texts = [words_of(x) for x in values]
    fresh = list({w for words in texts for w in words if w not in places})
    if fresh:
        places.update(zip(fresh, range(len(places), len(places) + len(fresh))))
        some = [models.bits(fresh[i : i + 20_000]).astype(np.float32) for i in range(0, len(fresh), 20_000)]
        _WORKER["scores"] = np.concatenate([_WORKER["scores"], *some])
    scores = _WORKER["scores"]
    for i, words in enumerate(texts):
        if words:
            sizes[i] = sum(map(len, words)) + len(words)
            out[i] = scores[[places[w] for w in words]].sum(0, dtype=np.float64) / sizes[i]
    return out, sizes


def labelled_sample(labelled: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> DataFrame:
    """At most `rows` different texts (text, lang) of each language, those with the lowest hashes.

    Only hashes are shuffled to count the texts; whole texts only of those below the bound.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest))
    known = known.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.withColumn("h", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return known.drop("h")
    span = 1 << 20
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(span, 4 * rows * span // n + 1))))
    some = known.where(F.pmod("h", F.lit(span)) < share[F.col("lang")]).distinct()
    by = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h", "text")
    return some.withColumn("r", F.row_number().over(by)).where(F.col("r") <= rows).select("text", "lang", "r")


MODEL = "lang string, keys binary, log_p binary, log_mass binary"


def fit(labelled: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> Models:
    """Models of all languages of `labelled` (text, lang), calibrated; four fifths of the sample train.

    NULL texts and languages are left out; without any rows there is no language.
    """
    spark = prepare(labelled.sparkSession)
    sample = labelled_sample(labelled, rows, longest)
    if "r" not in sample.columns:
        return Models.join({})
    sample = stored(sample, "languages")

    def learn(group: pa.Table) -> pa.Table:
        words: Counter = Counter()
        for text in group.column("text").to_pylist():
            words.update(words_of(text))
        if not words:
            return pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), *((x, pa.binary()) for x in ("keys", "log_p", "log_mass")))})
        arrays = [x.tobytes() for x in train(words)]
        return pa.table({"lang": group.column("lang")[:1].to_pylist(), "keys": [arrays[0]], "log_p": [arrays[1]], "log_mass": [arrays[2]]})

    for_training = sample.where((F.col("r") % 5 != 0) | (F.col("r") < 5))
    got = for_training.select("lang", "text").groupBy("lang").applyInArrow(learn, MODEL).collect()
    models = Models.join({r["lang"]: (np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["log_p"]), np.frombuffer(r["log_mass"])) for r in got})
    if not models.languages:
        return models
    shared = spark.sparkContext.broadcast(models)
    kept = sample.where(F.col("r") % 5 == 0)
    seen = _scored(kept, shared, "entropies array<double>, symbols long").where(F.col("entropies").isNotNull())
    rows_seen = seen.select("lang", "entropies", "symbols").collect()
    cut = kept.select("lang", "text", F.explode(F.array(*map(F.lit, CUTS))).alias("cut")).where(F.length("text") > F.col("cut"))
    cut = cut.select("lang", F.regexp_replace(F.col("text").substr(F.lit(1), F.col("cut")), rf"\S{{1,{RUN}}}$", "").alias("text"))
    cut = _scored(cut, shared, "symbols long, lang_pred string, cross_entropy double").where("lang = lang_pred")
    short = [(models.languages.index(r["lang"]), r["cross_entropy"], r["symbols"]) for r in cut.drop("text").collect()]
    _calibrate(models, [(models.languages.index(r["lang"]), r["entropies"], r["symbols"]) for r in rows_seen if r["lang"] in models.languages], short)
    shared.destroy()
    return models


def _calibrate(models: Models, rows: list[tuple[int, list[float], int]], short: list[tuple[int, float, int]]) -> None:
    """The sharpness with the best likelihood of the right language, and the limits of rejection.

    `rows` has the language, the entropies and the symbols of whole texts, `short` the language, its
    entropy and the symbols of cut ones.
    """
    models.limits, models.strays = np.full(len(models.languages), np.inf), np.zeros(len(models.languages))
    if not rows:
        return
    right = np.array([r[0] for r in rows])
    entropy = np.array([r[1] for r in rows])
    root = np.sqrt([r[2] for r in rows])

    def loss(sharpness: float) -> float:
        z = -sharpness * (entropy - entropy.min(1, keepdims=True))
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), right]).mean())

    models.sharpness = min((float(x) for x in np.geomspace(0.5, 100, 40)), key=loss)
    for i in range(len(models.languages)):
        mine = (right == i) & (entropy.argmin(1) == i)
        if mine.any():
            middle = np.median(entropy[mine, i])
            models.limits[i] = SLACK * middle
            cut = np.array([(e, np.sqrt(n)) for j, e, n in short if j == i]).reshape(-1, 2)
            away = np.concatenate([np.abs(entropy[mine, i] - middle) * root[mine], np.abs(cut[:, 0] - middle) * cut[:, 1]])
            models.strays[i] = SPREAD * DEVIATION * np.median(away)


def _scored(docs: DataFrame, shared: Broadcast, columns: str) -> DataFrame:
    """All columns of `docs` and those asked for, of entropies, lang_pred, score, cross_entropy, accepted."""
    added, key = T.StructType.fromDDL(columns), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            entropy, sizes = entropies(models, column(batch, "text").cast(pa.string()).to_pylist(), key)
            none = np.isnan(entropy).any(1) if models.languages else np.ones(len(entropy), bool)
            safe = np.where(none[:, None], 0.0, entropy)
            best = safe.argmin(1) if models.languages else np.zeros(len(safe), int)
            low = safe[np.arange(len(safe)), best] if models.languages else np.zeros(len(safe))
            odds = np.exp(-models.sharpness * (safe - low[:, None])).sum(1) if models.languages else np.ones(len(safe))
            limit = np.full(len(safe), np.inf)
            if models.limits is not None:
                limit = models.limits[best] + models.strays[best] / np.sqrt(np.maximum(sizes, 1))
            made = {
                "entropies": lambda: pa.array([None if n else e for n, e in zip(none.tolist(), entropy.tolist())], pa.list_(pa.float64())),
                "symbols": lambda: pa.array(sizes),
                "lang_pred": lambda: pa.array([UNKNOWN if n else models.languages[b] for n, b in zip(none.tolist(), best.tolist())], pa.string()),
                "score": lambda: pa.array(np.where(none, 0.0, 1 / odds)),
                "cross_entropy": lambda: pa.array(low, pa.float64(), mask=none),
                "accepted": lambda: pa.array(~none & (low <= limit)),
            }
            yield pa.record_batch([*batch.columns, *(made[f.name]() for f in added)], [*batch.schema.names, *added.names])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added.fields]))


def identify(docs: DataFrame, models: Models, keep: list[str] | None = None) -> DataFrame:
    """`keep` (all columns if not given) and lang_pred, score, cross_entropy, accepted of each row.

    A NULL text, and one without letters, is `und` with the score 0 and not accepted.  The score
    is the share of the best language in exp(-sharpness * cross-entropy).  Columns of `docs`
    with the names of results are replaced.
    """
    spark = prepare(docs.sparkSession)
    names = ["lang_pred", "score", "cross_entropy", "accepted"]
    rest = [c for c in keep or docs.columns if c.lower() not in names]
    rows = docs.select(*dict.fromkeys([*rest, "text"]))
    found = _scored(rows, spark.sparkContext.broadcast(models), "lang_pred string, score double, cross_entropy double, accepted boolean")
    return found.select(*rest, *names)
