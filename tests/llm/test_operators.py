"""Odd cases of each operator, and brute-force twins on small tables."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import CLASHES, LONG, ROWS, RUN
from timberline.llm import backoff, chat, common, decontamination, language, mixing, rollup, simhash, suite, token_files, topk, toxicity


def plain_words(text: str | None, alnum: bool = False) -> list[str]:
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        inside = (c >= "\x80" or c.isalnum()) if alnum else not (c == " " or "\t" <= c <= "\r")
        if inside:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] if word else out


# words and hashes


def test_scan_counts_and_tells_words_apart():
    items = [(r[1] or "").encode() for r in ROWS] + ["a b\x00c É é".encode(), b"\x01 \x00 \x01\x00"]
    for table, alnum in ((common.SPACED, False), (common.ALNUM, True)):
        hashes, counts = common.scan(items, table)
        words = [plain_words(i.decode(), alnum) for i in items]
        assert counts.tolist() == [len(w) for w in words]
        by: dict[int, str] = {}
        for h, w in zip(hashes.tolist(), itertools.chain(*words)):
            assert by.setdefault(h, w) == w
        assert len(by) == len({w for x in words for w in x})
    assert common.scan([], common.ALNUM)[0].shape == (0,)


def test_free_name_and_shared_folder(odd, spark):
    assert common.free_name(odd, "FP").lower() not in [c.lower() for c in odd.columns]
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


# 1 language


def test_character_model_is_a_distribution():
    """In a context, the probabilities of all symbols and of one unseen symbol sum to one."""
    from collections import Counter

    keys, log_p, log_mass = language.train(Counter({"abab": 3, "abc": 2, "ca": 1, "b": 4}))
    models = language.Models.join({"x": (keys, log_p, log_mass)})
    for start in ("", "a", "ab", "c", "zz"):
        whole = {s: float(models.bits([start + s])[0, 0]) for s in "abcz"}
        # the cost of start + s without that of the end sign after it
        total = sum(2 ** -(whole[s] - float(_end_cost(models, start + s))) for s in "abcz")
        prefix = 2 ** -(float(models.bits([start])[0, 0]) - float(_end_cost(models, start))) if start else 1.0
        total += 2 ** -float(models.bits([start])[0, 0])  # the word ends here
        assert total / prefix == pytest.approx(1, abs=0.12)


def _end_cost(models, word):
    """The bits of the end sign: the word's cost less the cost of its letters, found with an end that is never seen."""
    flat, place = language.symbols([word])
    bits = 0.0
    for n in range(min(language.ORDER, len(flat)), 0, -1):
        at = len(flat) - 1
        if place[at] < max(n - 1, 1):
            continue
        key = language.gram_hashes(flat, n)[at]
        i = np.searchsorted(models.keys, key)
        if i < len(models.keys) and models.keys[i] == key and not np.isnan(models.log_p[i, 0]):
            return bits - models.log_p[i, 0]
        if n > 1:
            key = language.gram_hashes(flat, n - 1)[at - 1]
            i = np.searchsorted(models.keys, key)
            if i < len(models.keys) and models.keys[i] == key:
                bits -= models.log_mass[i, 0]
    return bits - models.log_p[0, 0]


def test_language_odd_rows(odd, empty):
    models = language.fit(odd)
    rows = language.identify(odd, models).collect()
    assert len(rows) == len(ROWS)
    assert set(odd.columns) - {"score", "lang_pred", "accepted"} <= set(rows[0].asDict())
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert letters or (r["score"] == 0 and not r["accepted"])
    assert language.identify(empty, models).count() == 0
    none = language.fit(empty)
    assert {(r["lang_pred"], r["score"], r["accepted"]) for r in language.identify(odd, none).collect()} == {("und", 0.0, False)}


def test_language_of_number_signs(spark, odd):
    """Number signs are no letters, letters of any script are."""
    models = language.fit(odd)
    signs = ["½ ²", "①", "Ⅷ", "٣ ৪", "ª", "a²", "漢", "_", None]
    rows = language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(signs)], "doc_id long, text string"), models).collect()
    assert {r["doc_id"] for r in rows if r["lang_pred"] != "und"} == {4, 5, 6}


def test_language_sample_of_mass_copies(spark):
    """A text with a low hash and 2000 copies counts once, and never trains and calibrates both."""
    texts = [f"text number {i} of many" for i in range(3000)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    low = docs.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 20))).first()["text"]
    copies = spark.range(2000).select(F.lit(low).alias("text"), F.lit("en").alias("lang"))
    got = language.labelled_sample(docs.unionByName(copies)).collect()
    assert len(got) == len({r["text"] for r in got}) == language.ROWS and low in {r["text"] for r in got}


def test_language_rejects_what_is_in_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language.fit(docs)
    rng = random.Random(3)
    junk = ["".join(rng.choice("бвгджзклмнпрстфхцчшщъыьэюя漢字仮名") + rng.choice(["", " "]) for _ in range(2000)) for _ in range(5)]
    rows = language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string"), models).collect()
    assert not any(r["accepted"] for r in rows)


ITALIAN = (
    "La nostra vita è un viaggio che comincia con la speranza e finisce nella memoria di coloro che ci hanno amato. Ogni mattina il "
    "pescatore scendeva alla spiaggia, guardava le nuvole e decideva se mettere la barca in acqua oppure tornare a casa. Sua moglie "
    "preparava il pane mentre i ragazzi giocavano nel cortile, e la vecchia zia raccontava storie di quando il paese non aveva ancora "
    "luce elettrica. Nessuno sapeva quanto fosse lungo quell'inverno, ma tutti aspettavano insieme che tornasse il sole sopra le colline "
    "e che gli alberi del giardino mettessero di nuovo le foglie."
)
FINNISH = (
    "Suomen kesä on lyhyt mutta kaunis, ja järvien rannoilla ihmiset nauttivat auringosta, kun yöt ovat valoisia. Metsissä kasvaa "
    "mustikoita, joita lapset poimivat koreihinsa ennen kuin syksy tulee taas. Vanha kalastaja istui laiturilla ja katseli, kuinka "
    "pilvet liikkuivat hitaasti veden yläpuolella. Hänen poikansa oli muuttanut kaupunkiin töihin, mutta tuli joka viikonloppu "
    "käymään ja toi mukanaan tuoretta leipää. Illalla he lämmittivät saunan, puhuivat menneistä vuosista ja miettivät, tulisiko "
    "talvesta yhtä kylmä kuin silloin, kun meri jäätyi saariin asti ja hevoset kulkivat sen yli."
)


def test_language_rejects_short_texts_of_other_latin_languages(spark):
    """Texts of 50, 200 and 500 characters in languages that were not learned, and random letters; clean texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language.fit(docs)
    rng = random.Random(4)
    letters = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(100))
    others = [t[:n] for t in (ITALIAN, FINNISH, letters) for n in (50, 200, 500)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=43))]
    rows = language.identify(spark.createDataFrame([(t,) for t in others], "text string"), models).collect()
    assert [r["text"] for r in rows if r["accepted"]] == []
    for length in (60, 200, 500, None):
        short = docs.where(F.col("lang").isNotNull() & (F.length("text") >= (length or 1)))
        short = short.withColumn("text", F.substring("text", 1, length)) if length else short
        share = language.identify(short, models).agg(F.avg(F.col("accepted").cast("int"))).first()[0]
        assert share >= 0.99, length


# 2 mixing


def test_mixing_targets_by_hand(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 0), (None, 300)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    want, free, rest = {}, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, 1810.0
    size = dict(sizes)
    while True:  # share, stop what is above, share again
        share = {k: rest * w / sum(free.values()) for k, w in free.items()}
        over = [k for k in free if share[k] > 3 * size[k]]
        if not over:
            break
        for k in over:
            want[k] = 3.0 * size[k]
            rest -= want[k]
            del free[k]
    assert got == pytest.approx({**want, **share})


def test_mixing_odd_rows(odd, empty, spark):
    rows = mixing.with_copies(odd, mixing.word_count(F.col("text"))).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in rows)
    assert sorted(r["size"] for r in rows) == sorted(len(plain_words(r[1])) for r in ROWS)
    assert mixing.with_copies(empty, mixing.word_count(F.col("text"))).count() == 0
    many = mixing.mix(odd)
    assert many.columns == odd.columns and many.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mix_follows_rows_and_not_their_layout(spark):
    rows = [(i % 350, f"word {'more ' * (i % 7)}{i}", f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [sorted(tuple(r) for r in mixing.mix(docs.repartition(n).sortWithinPartitions(F.rand(n))).collect()) for n in (3, 7)]
    assert taken[0] == taken[1] and len(taken[0]) > 300


def test_mixing_hits_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.with_copies(docs, mixing.word_count(F.col("text")))
    by = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * r["most"] for r in by)


# 3 rollup


def test_rollup_is_idempotent(spark):
    def changes(*rows):
        return spark.createDataFrame(list(rows), "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, words string")

    totals = rollup.Rollup(spark, common.new_path(spark, "test"))
    state = lambda: sorted((str(r["source"]), str(r["lang"]), r["tokenizer"], r["n_docs"], r["n_tokens"]) for r in totals.totals().collect())
    assert state() == []
    first = changes(("insert", "a", "en", "t1", 5, None, "x"), ("insert", "a", "en", "t1", 5, None, "x"), ("insert", None, None, "t1", None, None, "x"))
    assert totals.apply("1", first) and not totals.apply("1", first)
    assert state() == [("None", "None", "t1", 1, 0), ("a", "en", "t1", 2, 10)]
    assert totals.apply("2", changes(("revise", "a", "en", "t1", 7, 5, "x"), ("delete", None, None, "t1", 0, None, "x")))
    assert state() == [("a", "en", "t1", 2, 12)]
    totals.compact()
    assert state() == [("a", "en", "t1", 2, 12)] and not totals.apply("2", first) and not totals.apply("1", first)
    assert totals.apply("3", changes().limit(0)) and state() == [("a", "en", "t1", 2, 12)]
    # a second driver commits the same batch: one of the two counts
    totals._commit("4", rollup.summed(rollup.signed(first)), [])
    totals._commit("4", rollup.summed(rollup.signed(first)), [])
    assert state() == [("None", "None", "t1", 1, 0), ("a", "en", "t1", 4, 22)]
    with pytest.raises(Exception, match="unknown change"):
        totals.apply("5", changes(("replace", "a", "en", "t1", 5, None, "x")))


def test_rollup_compactions_that_race(spark, monkeypatch):
    """A batch that comes in during a compaction, two compactions at once, and one on top of a void one."""
    path = common.new_path(spark, "test")
    totals, other = rollup.Rollup(spark, path), rollup.Rollup(spark, path)
    insert = lambda n: spark.createDataFrame([("insert", "a", "en", "t1", n, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    state = lambda: [(r["n_docs"], r["n_tokens"]) for r in totals.totals().collect()]
    totals.apply("1", insert(5))
    totals.apply("2", insert(10))
    commit = totals._commit

    def late(*change):
        monkeypatch.undo()
        other.apply("3", insert(100))
        other.compact()
        commit(*change)

    monkeypatch.setattr(totals, "_commit", late)
    totals.compact()
    assert state() == [(3, 115)]
    other.apply("4", insert(1000))
    other.compact()
    totals.compact()
    assert state() == [(4, 1115)] and not totals.apply("3", insert(1))


# 4 toxicity


def test_toxicity_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(i % 13, int(i % 13 > 6)) for i in range(40)] + [(1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(odd, labels.where("toxic = 1")), toxicity.fit(empty, labels), toxicity.fit(odd, labels.limit(0))):
        rows = model.score(odd, odd.columns).collect()
        assert len(rows) == len(ROWS)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
        assert model.score(empty, ["doc_id"]).count() == 0


def test_toxicity_features():
    lexicon = frozenset({"fool", "nasty", "nast*"})
    f = dict(zip(toxicity.FEATURES, toxicity.features_of("You FOOL! f00l n.a.s.t.y nastier", lexicon, {})))
    assert f["word_hits"] == 1 and f["start_hits"] == 1 and f["disguised_hits"] >= 1 and f["near_second"] > 0 and f["capital_words"] > 0
    assert toxicity.features_of(None, lexicon, {}) == toxicity.features_of("", lexicon, {}) == [0.0] * len(toxicity.FEATURES)
    assert all(math.isfinite(x) for t in (LONG, RUN, "   ", "!!!", "\x00") for x in toxicity.features_of(t, lexicon, {}))


# 5 token files


def test_token_files_odd_rows(odd, empty):
    path = suite.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rows = token_files.token_files(odd, path).orderBy("start").collect()
    ids = [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in ROWS]
    assert [r["doc_id"] for r in rows] == sorted((x[0] for x in ids), key=lambda d: (d is not None, d))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(
        (str(d), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids
    )
    assert [r["start"] for r in rows] == list(itertools.accumulate((r["n_tokens"] for r in rows), initial=0))[:-1]
    assert token_files.token_files(empty, path).count() == 0


def test_small_shards_and_wide_ids(odd, spark):
    path = suite.tokenizer_path()
    where = common.new_path(spark, "small")
    token_files.write_shards(odd, where, path, width=4, shard_ids=10)
    small = token_files.read_documents(spark, where).orderBy("start").collect()
    assert small == token_files.token_files(odd, path).orderBy("start").collect()


def test_words_are_encoded_as_in_their_text():
    path = suite.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t abé漢'12!<|endoftext|>\x1c ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [" ".join(rng.choice(["it's", "<|endoftext|>", "a,b", "3.5", "x\ny", "ß", "don't!"]) for _ in range(20)) for _ in range(50)]
    for text, got in zip(texts, token_files.encode_texts(texts, path, 2, 4)):
        assert np.frombuffer(got, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_elias_fano_selects():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 257, 3000):
        values = np.sort(rng.integers(0, 10 ** int(rng.integers(1, 9)), n))
        bits, low, high = token_files.EliasFano.encode(values)
        coded = token_files.EliasFano(n, bits, low, high)
        assert coded.values().tolist() == values.tolist() == [coded.select(i) for i in range(n)]
        assert len(low) + len(high) <= (n * (2 + max(0, math.ceil(math.log2(max(1, int(values[-1])) / n)))) + 16) / 8 + 2
    shard = token_files.Shard(token_files.pack([None, 3, 3, 9], [b"\x01\x00", b"\x02\x00\x03\x00", b"\x04\x00", b"\x05\x00"], 2))
    assert shard.doc_ids() == [None, 3, 3, 9] and shard.document(1).tolist() == [2, 3] and shard.document(0).tolist() == [1]


# 6 backoff


def test_backoff_odd_rows(odd, empty):
    rows = backoff.score(odd, block_words=30).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert all((r["n_words"] > 0 and r["log_score"] < 0) or (r["log_score"] == 0 and r["mean_log_score"] is None) or r["n_words"] for r in rows)
    assert backoff.score(empty).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_backoff_by_hand(spark, order):
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 12)))) for i in range(25)]
    from collections import Counter

    grams = lambda t: Counter(tuple(t[i : i + n]) for n in range(1, order + 1) for i in range(len(t) - n + 1))
    every, own = Counter(), {}
    for i, text in docs:
        own[i] = grams(text.split())
        every.update(own[i])
    total = sum(len(t.split()) for _, t in docs)
    want = {}
    for i, text in docs:
        words, value = text.split(), 0.0
        count = lambda g, i=i: every[g] - own[i][g]
        for p in range(len(words)):
            most = min(p, order - 1)
            for n in range(most, -1, -1):
                gram = tuple(words[p - n : p + 1])
                if count(gram) > 0 or n == 0:
                    base = count(gram[:-1]) if n else max(total - len(words), 1)
                    value += math.log((count(gram) if n else max(count(gram), 0.5)) / base) + (most - n) * math.log(0.4)
                    break
        want[i] = value
    rows = backoff.score(spark.createDataFrame(docs, "doc_id long, text string"), order=order, block_words=40).collect()
    assert {r["doc_id"]: r["log_score"] for r in rows} == pytest.approx(want)


# 7 simhash


def test_masks_cover_every_triple():
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15
    for t in itertools.combinations(range(64), 3):
        flips = sum(1 << p for p in t)
        assert any(not m & flips for m in masks)


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["component_id"] == by[1]["component_id"] == 1
    assert {by[i]["fingerprint"] for i in (3, 4, 5)} == {"0" * 16} and {by[i]["component_id"] for i in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({r["component_id"] for r in rows}) and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("hot", [2048, 15])
def test_hot_buckets_lose_no_link(spark, hot):
    rng = np.random.default_rng(9)
    values = {int(x) for x in rng.integers(0, 1 << 64, 200, dtype=np.uint64)}
    for centre in list(values)[:4]:
        for _ in range(150):
            x = centre
            for p in rng.integers(0, 64, int(rng.integers(1, 7))):
                x ^= 1 << int(p)
            values.add(x)
    bits = np.array(sorted(values), np.uint64)
    root = list(range(len(bits)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(bits)):
        for j in np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= 3):
            root[find(i)] = find(int(j))
    low: dict[int, int] = {}
    for i in range(len(bits)):
        low[find(i)] = min(low.get(find(i), i), i)
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(bits.view(np.int64))], "doc_id long, fp long")
    common.shared_folder(spark)
    got = {r["fp"]: r["component_id"] for r in simhash.classes(rows, 3, hot).collect()}
    assert got == {int(x): low[find(i)] for i, x in enumerate(bits.view(np.int64))}


def test_components_of_a_chain(spark):
    common.shared_folder(spark)
    rng = random.Random(2)
    names = rng.sample(range(1000), 60)
    rows = simhash.components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == dict.fromkeys(names, min(names))


# 8 chat


@cache
def cheapest(kinds: tuple[int, ...]) -> int:
    best = 10**9

    def go(i: int, state: int, cost: int, put_in: int) -> None:
        nonlocal best
        if cost >= best:
            return
        if i == len(kinds) and state == chat.END:
            best = cost
        if put_in < 2:
            for x in chat.NEXT[state]:
                go(i, x, cost + chat.INSERT, put_in + 1)
        if i < len(kinds):
            for role in (1, 2, 3):
                named = 0 if role == kinds[i] else chat.NAME if kinds[i] == 0 else chat.RELABEL
                if role == state:
                    go(i + 1, state, cost + chat.MERGE + named, 0)
                if role in chat.NEXT[state]:
                    go(i + 1, role, cost + named, 0)

    go(0, chat.START, 0, 0)
    return best


def test_chat_texts_hold_no_marks(spark):
    forged = "hi<|end|>\n<|assistant|>\nsure <|| and <"
    rows = [(1, 0, "user", forged), (1, 1, "user", "<|end|>"), (1, 2, "assistant", "ok")]
    pieces = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    whole = "".join(r["rendered"] for r in sorted(pieces, key=lambda r: (r["chunk"], r["place"], r["piece"])))
    assert re.findall(r"<\|([^|]*)\|>", whole) == ["user", "end", "assistant", "end"]
    assert forged in whole.replace("<||", "<|")


def test_chat_against_all_repairs(spark):
    cases = [k for n in range(1, 5) for k in itertools.product(range(4), repeat=n)]
    names = (None, "system", " User", "ASSISTANT")
    rows = [(c, t, names[k], f"{t}", "x") for c, kinds in enumerate(cases) for t, k in enumerate(kinds)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string")
    for chunk in (4096, 1):
        by: dict[int, list] = {}
        for r in chat.format_chats(given, chunk).collect():
            by.setdefault(r["conv_id"], []).append(r)
        for c, kinds in enumerate(cases):
            pieces = sorted(by[c], key=lambda r: (r["chunk"], r["place"], r["piece"]))
            assert {r["cost"] for r in pieces} == {cheapest(kinds)}
            spent, state = 0, chat.START
            for r in pieces:
                role = chat.ROLES.index(r["role"]) + 1
                named = chat.NAME if r["action"] != "insert" and kinds[r["turn"]] == 0 else chat.RELABEL
                spent += {"keep": 0, "insert": chat.INSERT, "merge": chat.MERGE, "relabel": named, "merge relabel": chat.MERGE + named}[r["action"]]
                assert role == state if r["action"].startswith("merge") else role in chat.NEXT[state]
                state = role
            assert state == chat.END and spent == cheapest(kinds)
            text = "".join(r["rendered"] for r in pieces)
            assert text.count("<|end|>\n") == sum(not r["action"].startswith("merge") for r in pieces)


def test_chat_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, "user", None), (1, 0, None, ""), (1, 0, None, ""), (2, 0, "bot", LONG)]
    rows += [(3, i, "user", "u") for i in range(5000)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(given, 512).collect()
    assert sum(r["action"] != "insert" for r in got) == len(rows)
    assert {r["cost"] for r in got if r["conv_id"] is None} == {0}
    assert {r["cost"] for r in got if r["conv_id"] == 3} == {4998 + chat.RELABEL}  # the last turn becomes the answer
    assert chat.format_chats(given.limit(0)).count() == 0


def test_chat_chunks_are_bounded_and_change_nothing(spark):
    """Long conversations whose turns are NULL or equal, and a NULL conversation, are cut into chunks of bounded size."""
    rng = random.Random(6)
    role = lambda: rng.choice(["user", "assistant", "system", None])
    rows = [(c, t, role(), f"{i % 700}") for c, t in ((None, 1), (1, None), (2, 7), (3, None)) for i in range(1500)]
    rows += [(4, i, role(), f"{i}") for i in range(1500)] + [(5, 10**12 * i, "user", "far") for i in range(-3, 4)]
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)

    def read(chunk: int) -> tuple[dict, dict, int]:
        by: dict = {}
        for r in chat.format_chats(given, chunk).collect():
            by.setdefault(r["conv_id"], []).append(r)
        most = max(r["place"] for x in by.values() for r in x) + 1
        turns = {c: sorted({(r["chunk"], r["place"]) for r in x}) for c, x in by.items()}
        return {c: {r["cost"] for r in x} for c, x in by.items()}, turns, most

    costs, turns, most = read(100)
    assert most <= 100 and {c: len(x) for c, x in turns.items()} == {None: 1500, 1: 1500, 2: 1500, 3: 1500, 4: 1500, 5: 7}
    assert turns[5] == [(0, i) for i in range(7)]
    assert costs == read(4096)[0]


def test_chat_order_across_chunks(spark):
    rows = [(1, None if i % 3 == 0 else i % 2, "user", f"{i:03}") for i in range(400)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), 64).collect()
    text = "".join(r["rendered"] for r in sorted(got, key=lambda r: (r["chunk"], r["place"], r["piece"])))
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[3]))
    assert re.findall(r"\d{3}", text) == [r[3] for r in order]


# 9 top-k


def test_topk_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 400)]  # ties
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7), (450, [0.0] * 8), (450, [1.0] * 8)]
    rows += [(500, [1.0, 2.0]), (501, [3.0, -1.0]), (550, []), (None, [0.1] * 8)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got: dict[int, list] = {}
    for r in topk.top_neighbours(vectors).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in {i for i, _ in fine if i % 50 == 0 and i not in (450, 550)}:
        query = dict(fine)[q]
        best = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in fine if i != q and len(v) == len(query))[:5]
        assert sorted(got[q]) == [(r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert 550 not in got and topk.top_neighbours(vectors.limit(0)).count() == 0


def test_topk_of_repeated_ids(spark):
    """Rows of one id, alike or not, are queries and candidates each; no query finds its own row."""
    rng = random.Random(12)
    rows = [(rng.randrange(12) * 25, [rng.randrange(-3, 4) / 4 for _ in range(3)]) for _ in range(150)]
    rows += [(50, [1.0, 0.0, 0.5]), (50, [0.5, 0.5, 0.0])] + [(100, [0.25, 0.75, -0.5])] * 4
    got = sorted(tuple(r) for r in topk.top_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect())
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 50 == 0:
            others = [(-sum(int(256 * a) * int(256 * b) for a, b in zip(v, w)), c) for j, (c, w) in enumerate(rows) if j != i]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(others)[:5], 1)]
    assert got == sorted(want)
    alone = topk.top_neighbours(spark.createDataFrame([(50, [1.0]), (50, [2.0]), (100, [1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, alone)) == sorted(
        [(50, 1, 50, 131072), (50, 2, 100, 65536), (50, 1, 50, 131072), (50, 2, 100, 131072), (100, 1, 50, 131072), (100, 2, 50, 65536)]
    )


def test_topk_of_large_components(spark):
    """Components of any size enter as they are; what does not fit 64 bits is an error."""
    rng = np.random.default_rng(9)
    vectors = [(rng.normal(0, 1, 64) * 10.0 ** rng.integers(0, 6, 64)).tolist() for _ in range(150)]
    vectors += [[2.0**25 * (i + 1)] + [0.0] * 63 for i in range(3)] + [[1.0 / 256] + [0.0] * 63, [-1.0 / 256, 2.0**20] + [0.0] * 62]
    ids = [*range(150), 201, 202, 203, 200, 250]
    whole = [[math.floor(256 * x) for x in v] for v in vectors]
    everything = list(zip(ids, whole))
    schema = "vec_id long, embedding array<double>"
    got = topk.top_neighbours(spark.createDataFrame(list(zip(ids, vectors)), schema).repartition(2)).collect()
    for q in (0, 50, 100, 200, 250):
        query = dict(everything)[q]
        best = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in everything if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(r, i, -x) for r, (x, i) in enumerate(best, 1)]
    for bad in ([1e300, 0.0], [2.0**40, 2.0**40]):
        with pytest.raises(Exception, match="does not fit 64 bits"):
            topk.top_neighbours(spark.createDataFrame([(0, bad), (1, bad)], schema)).collect()


# 10 decontamination


def test_decontamination_against_plain_search(spark, odd, empty):
    rng = random.Random(8)
    vocabulary = ["ab", "é", "x1", "the", "Of", "漢字"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 13, 14, 20]))) for i in range(30)] + [(30, None), (31, ""), (7, "the of"), (None, "ab é ab é")]
    docs = [(i, text(rng.choice([0, 2, 30, 200])) + " " + (rng.choice(items)[1] or "")) for i in range(60)] + [(60, None), (61, ""), (5, "x1 x1 x1")]
    got = decontamination.contamination(
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, shard string").repartition(4),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, slot string"),
        window=13,
    ).collect()
    want = []
    for doc_id, t in docs:
        words = plain_words(t, True)
        hit, found = set(), set()
        for item_id, it in items:
            w = plain_words(it, True)
            n = min(13, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[k : k + n]:
                        hit.update(range(p, p + n))
                        found.add(item_id)
        names = sorted(str(x) for x in found if x is not None)
        want.append((doc_id, len(words), len(hit), len(names), names, bool(hit) and 20 * len(hit) >= len(words)))
    assert sorted(tuple(r) for r in got) == sorted(want)
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.contamination(odd, none).collect()
    assert len(rows) == len(ROWS) and not any(r["n_hit"] for r in rows)
    assert decontamination.contamination(empty, none).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    """Many blocks of items, which are too large to broadcast, give the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.contamination(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    split = decontamination.item_blocks
    monkeypatch.setattr(decontamination, "item_blocks", lambda items: split(items, 7))
    assert sorted(map(tuple, decontamination.contamination(docs, items).collect())) == whole


def test_proximity(spark):
    docs = [(1, "a x b"), (2, "a x x x b"), (3, "b a"), (4, "a"), (5, "c a b a c"), (6, None)]
    path = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), common.new_path(spark, "near"))
    rows = decontamination.proximity_matches(spark, path, ["a", "B"], 3).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 2), (3, 0, 1), (5, 1, 2), (5, 2, 3)]
    assert decontamination.proximity_matches(spark, path, ["zz"], 3).count() == 0


def test_clashing_names_are_in_the_table(odd):
    assert set(CLASHES) <= set(odd.columns)
