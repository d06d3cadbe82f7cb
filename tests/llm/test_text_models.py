"""Language, quality and toxicity models: held-out results, brute-force versions, edges."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import common, langid, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 !! ..."), (4, "x"), (5, "the " * 40_000), (6, "\u0000� 中文"), (1, None)]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0.5, "s") for i, t in ODD], "doc_id long, text string, lang string, score double, source string")


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.asarray(y) == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_language_held_out(spark):
    rows = langid.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) == 1000
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert rows.score.between(0, 1).all()
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("h"))
    assert want.where("h").count() == rows.held_out.sum()


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    en = docs.where("lang = 'en' and n_chars > 3000").orderBy("doc_id").first()["text"][:1500]
    de = docs.where("lang = 'de' and n_chars > 3000").orderBy("doc_id").first()["text"][:1500]
    mixed = spark.createDataFrame([(1, en + "\n" + de), (2, en)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(mixed, model).collect()}
    assert got[1]["n_langs"] == 2
    assert {x.split(":")[0] for x in got[1]["shares"].split()} == {"de", "en"}
    assert abs(float(got[1]["shares"].split()[0].split(":")[1]) - 0.5) < 0.15
    assert (got[2]["n_langs"], got[2]["lang_pred"]) == (1, "en")


def test_mixture_against_loops():
    rng = np.random.default_rng(0)
    ll = np.log(rng.dirichlet(np.ones(4), 30)).astype(np.float32)
    counts = np.array([10, 0, 20])
    share, size, alone = langid.mixtures(ll, counts)
    for d, (a, b) in enumerate([(0, 10), (10, 10), (10, 30)]):
        words = ll[a:b].astype(float)
        np.testing.assert_allclose(alone[d], words.sum(axis=0), rtol=1e-4, atol=1e-4)
        if a == b:
            continue

        def em(allowed, start, words=words):
            pi = np.where(allowed, start + 1e-3, 0)
            pi = pi / pi.sum()
            for _ in range(langid.ROUNDS):
                r = pi * np.exp(words)
                pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            return pi, np.log((pi * np.exp(words)).sum(axis=1)).sum()

        full, _ = em(np.ones(4, bool), np.full(4, 0.25))
        best, k = words.sum(axis=0).max(), 1
        pick = np.eye(4)[words.sum(axis=0).argmax()]
        for m in (2, 3):
            pi, fit = em(np.isin(np.arange(4), np.argsort(-full)[:m]), full)
            value = fit - langid.PENALTY * (m - 1) * math.log(b - a + 1)
            if value > best:
                best, k, pick = value, m, pi
        assert size[d] == k
        np.testing.assert_allclose(share[d], pick, atol=1e-2)


def invented(rng, k):
    """Words of the k-th of many made-up languages, each with syllables of its own."""
    own = np.random.default_rng(1000 + k)
    syllables = ["".join(own.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
    return lambda n: " ".join("".join(rng.choice(syllables, 2)) for _ in range(n))


def test_more_than_64_languages(spark):
    rng = np.random.default_rng(7)
    say = [invented(rng, k) for k in range(90)]
    rows = [(100 * k + i, f"l{k:02}", say[k](60)) for k in range(90) for i in range(2 if k > 70 else 3)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(model.langs) == 90
    asked = spark.createDataFrame([(k, say[k](60)) for k in range(90)] + [(500, " ".join(say[k](60) for k in (1, 75, 80, 85, 88)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(asked, model).collect()}
    assert [got[k]["lang_pred"] for k in range(90)] == [f"l{k:02}" for k in range(90)]
    assert got[500]["n_langs"] == 5
    assert {x.split(":")[0] for x in got[500]["shares"].split()} == {"l01", "l75", "l80", "l85", "l88"}


def test_evenly_mixed_documents_are_kept(spark):
    rng = np.random.default_rng(8)
    say = [invented(rng, k) for k in range(5)]
    rows = [(100 * k + i, f"l{k}", say[k](80)) for k in range(5) for i in range(40)]
    mixed = [(1000 + i, None, " ".join(w for x in zip(*(say[k](100).split() for k in rng.permutation(5)[:3]), strict=True) for w in x)) for i in range(40)]
    docs = spark.createDataFrame([*rows, *mixed, (2000, None, "12 .. 7"), (2001, None, "\u4e2d\u6587" * 50)], "doc_id long, lang string, text string")
    assert langid.identified(docs).where("doc_id between 1000 and 1999 and n_langs = 3 and score < 0.2").count() > 5
    assert {r["doc_id"] for r in langid.kept(docs).collect()} == {r[0] for r in [*rows, *mixed]}


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(odd(spark), langid.learn(docs)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "en")} <= got
    assert langid.predict(odd(spark), langid.learn(docs)).count() == len(ODD)
    nothing = langid.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(odd(spark), nothing).collect()} == {"und"}
    assert langid.kept(docs.where("false")).count() == 0
    kept = langid.kept(docs.withColumn("lang_pred", F.lit(1)))
    assert kept.columns == [*docs.columns, "lang_pred"]
    assert kept.count() >= 0.98 * docs.count()


@pytest.mark.parametrize("text", ["\u20ac \u2014 123", "\u201c\u2026\u201d", "\u0661\u0662\u0663", "\U0001f600 42", "\u00a0\u00a0", "\u0301", "\u2460\u00bd"])
def test_texts_without_a_letter(text):
    model = langid.Model(["a", "b"], np.full((langid.BUCKETS, 2), -11.0, np.float32))
    assert langid.judged(model, pa.array([text]))[0] == ["und"]
    assert langid.judged(model, pa.array([text + " \u65e5"]))[0] == ["a"]


def test_language_of_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    model = langid.Model(list("abcd"), np.log(rng.dirichlet(np.ones(langid.BUCKETS) * 0.3, 4).T + 1e-9).astype(np.float32))
    words = ["".join(rng.choice(list("abcdefgh\u00e9"), int(n))) for n in rng.integers(2, 9, 500)]
    texts = pa.array([" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 2000, 20)] + ["", None, "1 2", "x" * 5000])
    whole = langid.judged(model, texts)
    monkeypatch.setattr(langid, "parts", lambda data, offsets, limit=0: common.parts(data, offsets, 1500))
    cut = langid.judged(model, texts)
    assert whole[0][:-1] == cut[0][:-1]
    assert whole[2][:-1] == cut[2][:-1]
    assert np.allclose(whole[1][:-1], cut[1][:-1], atol=1e-5)
    assert np.allclose(whole[4][:-1], cut[4][:-1], atol=1e-5)


def test_language_query_against_brute_force(spark):
    """The query's own learning, word likelihoods and mixtures, by dictionaries and loops."""
    from collections import Counter
    from zlib import crc32

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    words = lambda t: re.findall(r"[^\W\d_]+", t or "")

    def grams(word):
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" and c != "\u00d7" else c for c in word).encode()
        padded = b" " + raw + b" \x00"
        for k in range(len(raw)):
            code = int.from_bytes(padded[k : k + 4], "little")
            yield (code * 2654435761 & 0xFFFFFFFF) >> 16

    seen = {}
    for d in docs:
        if crc32(str(d["doc_id"]).encode()) % 4 != 2 and d["lang"] is not None:
            seen.setdefault(d["lang"], Counter()).update(g for w in words(d["text"]) for g in grams(w))
    langs = sorted(seen)
    total = {x: sum(seen[x].values()) for x in langs}
    logp = lambda x, g: math.log((seen[x][g] + 0.5) / (total[x] + 0.5 * 65536))
    got = {r["doc_id"]: r for r in langid.query(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs[::12]:
        each = [[sum(logp(x, g) for g in grams(w)) for x in langs] for w in words(d["text"])]
        r = got[d["doc_id"]]
        assert r["held_out"] == (crc32(str(d["doc_id"]).encode()) % 4 == 2)
        if not each:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        alone = [sum(w[k] for w in each) for k in range(len(langs))]
        share = [1 / len(langs)] * len(langs)
        for _ in range(40):
            now = [0.0] * len(langs)
            for w in each:
                part = [s * math.exp(v - max(w)) for s, v in zip(share, w, strict=True)]
                now = [a + b / sum(part) / len(each) for a, b in zip(now, part, strict=True)]
            share = now
        # one language, or the main one of the full mixture where the penalty allows more
        assert r["lang_pred"] in {langs[alone.index(max(alone))], langs[share.index(max(share))]}


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows.quality, rows.tail_prob) > 0.93
    clean = rows[(rows.quality == 1) & (rows.toxic == 0)]
    assert clean.selected.mean() > 0.99
    assert auc(1 - rows[rows.quality == 1].toxic, rows[rows.quality == 1].expected_grade) > 0.9


def test_ordinal_fit_and_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    y = np.digitize(x + rng.logistic(size=3000) * 0.3, [-0.5, 0.7]).astype(float)
    at, share = np.tile([0, 1], 3000), np.stack([np.maximum(x, 0), np.maximum(-x, 0)], 1).ravel()
    m = quality.fit(y, at, share, np.full(3000, 2), 2)
    assert m.grades == [0.0, 1.0, 2.0]
    assert m.cuts[0] < m.cuts[1]
    z = share.reshape(-1, 2) @ m.weights
    tail = 1 / (1 + np.exp(m.cuts - z[:, None]))
    assert (tail[:, 0] >= tail[:, 1]).all()
    assert abs(tail[:, 0].mean() - (y >= 1).mean()) < 0.05
    assert np.corrcoef(tail.sum(axis=1), y)[0, 1] > 0.7
    assert quality.fit(np.array([2.0, 2.0]), np.zeros(0, int), np.zeros(0), np.zeros(2, int)).grades == [2.0]


def test_fit_in_blocks_is_the_fit(monkeypatch):
    """Blocks of any size, rows without features and rows larger than a block give the same model as one block."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 30, 400)
    sizes[[0, 7, 399]], sizes[100] = 0, 500
    at = np.concatenate([rng.choice(600, n, replace=False) for n in sizes]).astype(np.uint16)
    share = rng.random(len(at)).astype(np.float32) / 30
    y = rng.integers(0, 3, 400).astype(float)
    whole = quality.fit(y, at, share, sizes, 600)
    for size in (1, 64, 1000):
        monkeypatch.setattr(quality, "AT_ONCE", size)
        part = quality.fit(y, at, share, sizes, 600)
        assert np.allclose(part.weights, whole.weights) and np.allclose(part.cuts, whole.cuts)


def test_texts_of_a_fit_are_bounded_in_features(spark):
    rows = spark.createDataFrame([(i, bytes(2 * (i % 9))) for i in range(60)], "id long, at binary")
    order = [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").collect()]
    for most in (1, 20, 100, 239, 240, 10_000):
        got = {r["id"] for r in quality.fitting(rows, most).collect()}
        room = max(sum(1 for k in range(60) if sum(i % 9 for i in order[: k + 1]) <= most), 1)
        assert got == set(order[:room])
    assert quality.fitting(rows.where("false")).count() == 0


def test_quality_score_against_loops(spark):
    rng = np.random.default_rng(2)
    m = quality.Model([0.0, 1.0, 2.0], rng.normal(size=quality.ALL), np.array([-0.5, 0.5]))
    import pyarrow as pa

    texts = ["", None, "ab", "abc", "The THE the the!! x9", "one\ntwo  two", "é à"]
    _, expected, tail = quality.judged(m, pa.array(texts))
    for t, e, p in zip(texts, expected, tail, strict=True):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        grams = quality._buckets(raw)
        shapes = quality._shapes(raw, np.array([0, len(raw)]))[0]
        z = m.weights[grams].sum() / (len(grams) + quality.SHORT_GRAMS) + m.weights[shapes].sum() / (len(shapes) + quality.SHORT_WORDS)
        tails = [1 / (1 + math.exp(c - z)) for c in m.cuts]
        assert p == pytest.approx(tails[0])
        assert e == pytest.approx(sum(tails))


def test_quality_query_against_loops(spark):
    """Which ratings are learned from, and every row's grade, expectation and tail, by loops."""
    from zlib import crc32

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rated = {r["doc_id"]: r["grade"] for r in quality.ratings(labels).collect()}
    for r in labels.collect():
        kept = crc32(str(r["doc_id"]).encode()) % 5 != 0
        assert (r["doc_id"] in rated) == kept
        if kept:
            assert rated[r["doc_id"]] == (0 if r["quality"] == 0 else 1 if r["toxic"] == 1 else 2)
    model = quality.learn(spark.read.parquet(f"{SF}/documents.parquet"), quality.ratings(labels))
    assert len(model.grades) == len(model.cuts) + 1
    assert (np.diff(model.cuts) > 0).all()
    got = {r["doc_id"]: r for r in quality.query(spark, SF).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        raw = np.frombuffer((text or "").encode(), np.uint8)
        grams, (shapes, _) = quality._buckets(raw), quality._shapes(raw, np.array([0, len(raw)]))
        z = sum(float(model.weights[b]) for b in grams) / (len(grams) + 100) + sum(float(model.weights[b]) for b in shapes) / (len(shapes) + 20)
        tail = [1.0, *[1 / (1 + math.exp(c - z)) for c in model.cuts], 0.0]
        each = [a - b for a, b in zip(tail[:-1], tail[1:], strict=True)]
        r = got[d]
        assert abs(r["tail_prob"] - tail[1]) < 1e-6
        assert abs(r["expected_grade"] - sum(p * g for p, g in zip(each, model.grades, strict=True))) < 1e-6
        assert r["selected"] == (r["tail_prob"] >= 0.5)


def test_quality_edges(spark):
    docs = odd(spark)
    ratings = spark.createDataFrame([(1, 0), (4, 2), (5, None), (None, 1), (99, 1), (4, 1)], "doc_id long, grade int")
    model = quality.learn(docs, ratings)
    assert model.grades == [0.0, 1.0]
    assert quality.predict(docs, model).count() == len(ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.kept(docs, labels).count() == len(ODD)
    assert quality.rated(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("i d i o t", "idiot"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("losssser", "loser"), ("d1sgu$t!ng", "disgusting"), ("m0r0n", "moron"), ("p@thetic", "pathetic"), ("S T U P I D", "stupid"), ("tra5h", "trash")])
def test_restore(spark, written, meant, lm={}):
    if not lm:
        lm[0] = toxicity.bigrams(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert toxicity.restore(written.lower(), lm[0]) == meant


def test_viterbi_against_all_paths(spark):
    """The best path of a lattice is the best of all its readings."""
    from itertools import product

    rng = np.random.default_rng(4)
    lm = np.log(rng.dirichlet(np.ones(256), 256))
    for span in ("a1b", "0o0", "x!y", "a-b", "ss5"):
        options = []
        for k, s in enumerate(span):
            if s in toxicity.SEPARATORS:
                options.append([("", toxicity.DROP)])
            elif s in toxicity.SIGNS:
                options.append([(x, toxicity.IMITATE) for x in toxicity.SIGNS[s]] + [(s, toxicity.KEEP)] + ([("", toxicity.REPEAT)] if span[k + 1 : k + 2] == s else []))
            else:
                options.append([(s, 0.0)] + ([("", toxicity.REPEAT)] if k and span[k - 1] == s else []))
        best = max((sum(c for _, c in path) + sum(lm[a, b] for a, b in zip(f" {w} ".encode()[:-1], f" {w} ".encode()[1:], strict=True)), w) for path in product(*options) for w in ["".join(x for x, _ in path)])
        assert toxicity.restore(span, lm) == best[1]


def test_restore_of_a_long_span():
    lm = np.log(np.full((256, 256), 1 / 256))
    assert len(toxicity.restore("a1" * 50_000, lm)) == 100_000


def test_suspicious_spans():
    raw = np.frombuffer("plain word*** a1b 2024 3d i d i o t losssser A | B x".encode(), np.uint8)
    found = {raw[a:b].tobytes().decode() for a, b in zip(*toxicity.suspicious(raw, np.array([0, len(raw)])), strict=True)}
    assert {"a1b", "i d i o t", "losssser"} <= found
    assert not found & {"plain", "word", "2024"}


@pytest.mark.parametrize("written", ["shi7", "hat3", "dumb4$$", "idi07", "5h17", "i - d - i - o - t", "id io t", "iiddiioott", "i d \u00ef o t", "i...d...i...o...t"])
def test_obfuscated_spans_reach_the_decoder(spark, written):
    lm = toxicity.bigrams(spark.createDataFrame([("idiot shit hate dumbass you are an such",)] * 3, "text string"))
    raw = np.frombuffer(f"plainly, {written}, largely".encode(), np.uint8)
    found = {raw[a:b].tobytes().decode() for a, b in zip(*toxicity.suspicious(raw, np.array([0, len(raw)]), lm), strict=True)}
    assert found == {written}
    meant = {"shi7": "shit", "hat3": "hate", "dumb4$$": "dumbas", "5h17": "shit", "i d \u00ef o t": "id\u00efot"}.get(written, "idiot")
    assert toxicity.restore(written, lm) == meant


@pytest.mark.parametrize(("written", "meant"), [("\u0456d\u0456ot", "idiot"), ("\u0456di0t", "idiot"), ("sh\u200bit", "shit"), ("h\u00ada\u00adte", "hate"), ("\uff49\uff44\uff49\uff4f\uff54", "idiot"), ("\uff29\uff24\uff29\uff2f\uff34", "idiot"), ("h\u03b1t\u0435", "hate"), ("\u0456 d \u0456 o t", "idiot"), ("dum\ufeffb\u0410ss", "dumbas")])
def test_look_alike_letters(spark, written, meant):
    lm = toxicity.bigrams(spark.createDataFrame([("idiot shit hate dumbass you are an such",)] * 3, "text string"))
    raw = np.frombuffer(f"plainly, {written}, largely".encode(), np.uint8)
    found = {raw[a:b].tobytes().decode() for a, b in zip(*toxicity.suspicious(raw, np.array([0, len(raw)]), lm), strict=True)}
    assert found == {written}
    assert toxicity.restore(common.lower(np.frombuffer(written.encode(), np.uint8)).tobytes().decode(), lm) == meant


def test_words_of_other_scripts_stay():
    lm = np.log(np.full((256, 256), 1 / 256))
    for text in ("\u0441\u043e\u0440\u0430", "\u03ba\u03b1\u03b9", "\u0646\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "na\u00efve"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert not len(toxicity.suspicious(raw, np.array([0, len(raw)]), None)[0])
        assert toxicity.restore(text, lm) == text


def test_toxicity_held_out_and_planted(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    base = docs.where("lang = 'en' and n_chars between 400 and 900").join(labels.where("quality = 1 and toxic = 0"), "doc_id").orderBy("doc_id").limit(6).select("doc_id", "text").collect()
    planted = []
    for k, r in enumerate(base):
        words = r["text"].split()
        plain = list(words)
        words[10:10] = ["y0u", "st00pid", "1d10t"][: 1 + 2 * (k % 2)] + ["m0r0n", "w o r t h l e s s", "p@thetic", "tra5h"]
        planted.append((10_000_000 + k, " ".join(words)))
        plain[10:10] = ["stup\u0456d", "m\u043er\u043en", "w\u200borth\u200bless", "p\u0430thet\u0456c", "\uff54\uff52\uff41\uff53\uff48"]
        planted.append((10_000_100 + k, " ".join(plain)))
    more = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    model = toxicity.learn(docs, labels.where(~langid.held_out(5, 0)).select("doc_id", "toxic"))
    rows = toxicity.predict(more, model).toPandas().set_index("doc_id").score
    assert (rows[[i for i, _ in planted]] >= 0.5).all()
    truth = labels.where(langid.held_out(5, 0)).where("quality = 1").toPandas().set_index("doc_id").toxic
    assert auc(truth, rows[truth.index]) > 0.99
    assert (rows[truth[truth == 0].index] < 0.5).mean() > 0.98


def test_restored_spans_against_one_by_one(spark):
    lm = toxicity.bigrams(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = random.Random(3)
    pieces = ["elle", "th\u00e9\u00e9e", "a b  c", "d.u.m.b", "sh1t", "wow!!", "id io t", "\u65e5\u65e5", "of of", "x", "coooool", "y0u", "A  B", "b$$", "\u00c9\u00e9a", "\u0456d\u0456ot", "a \u0435 x", "\u0430 \u0435 \u0445", "of\u200bff", "\uff21b"]
    texts = [" ".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(60)]
    data, offsets = common.packed(pa.array(texts))
    want = [[] for _ in texts]
    for a, b in zip(*toxicity.suspicious(data, offsets, lm), strict=True):
        raw = common.lower(data[a:b]).tobytes()
        found = toxicity.restore(raw.decode(errors="replace"), lm).encode()
        if found != raw:
            want[int(np.searchsorted(offsets, a, "right")) - 1] += found.split()
    got = [[] for _ in texts]
    for text, at in toxicity._restored(data, offsets, lm, {}):
        for k in range(len(texts)):
            got[k] += text.tobytes()[at[k] : at[k + 1]].split()
    assert [sorted(x) for x in got] == [sorted(x) for x in want]


def test_toxicity_query_against_brute_force(spark):
    """Word odds, features and the logistic score of the query, by dictionaries and loops over the restored texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~langid.held_out(5, 0)).select("doc_id", "toxic"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.where(~langid.held_out(5, 0)).where("toxic is not null and doc_id is not null").collect()}

    def buckets(text):
        data, offsets = common.packed(pa.array([text]))
        found = [toxicity.restore(common.lower(data[a:b]).tobytes().decode(errors="replace"), model.lm) for a, b in zip(*toxicity.suspicious(data, offsets, model.lm), strict=True)]
        raw = [common.lower(data[a:b]).tobytes().decode(errors="replace") for a, b in zip(*toxicity.suspicious(data, offsets, model.lm), strict=True)]
        rows = [toxicity._words(*common.packed(pa.array([x])))[0] for x in [text, *[f for f, r in zip(found, raw, strict=True) if f != r]]]
        return np.concatenate(rows)

    all_buckets = {d: buckets(t) for d, t in texts.items()}
    n = np.zeros((2, toxicity.BUCKETS))
    size = [0, 0]
    for d, y in known.items():
        if d in texts:
            size[y] += 1
            for b in set(all_buckets[d].ravel().tolist()):
                n[y, b] += 1
    value = np.log((n[1] + 0.02) / (size[1] + 1)) - np.log((n[0] + 0.5) / (size[0] + 1))
    odds = np.where(n[1] > 1, np.maximum(value, 0), 0)
    assert np.allclose(odds, model.odds, atol=1e-5)
    got = {r["doc_id"]: r for r in toxicity.query(spark, SF).collect()}
    assert set(got) == set(texts)
    for d, b in all_buckets.items():
        best = sorted((odds[row].max() for row in b), reverse=True)
        over = lambda t, best=best: sum(v > t for v in best)
        top = (best + [0.0, 0.0])[:2]
        x = [*top, *[math.log1p(over(t)) for t in (1, 2, 3)], math.log1p(1000 * over(2) / max(1, len(best))), math.log1p(len(best)) / 10]
        score = 1 / (1 + math.exp(-sum(a * w for a, w in zip(x, model.weights, strict=True)) - model.bias))
        assert abs(got[d]["score"] - score) < 1e-3, d
        assert got[d]["predicted"] == (got[d]["score"] >= 0.5)


def test_clashing_columns(spark):
    clash = {x: F.lit(7) for x in ("toxic", "half", "_id", "_doc", "y", "x", "at", "share", "grade", "_gone", "key", "node", "root", "score", "count")}
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    more = docs.withColumns(clash)
    wide = labels.withColumns({x: v for x, v in clash.items() if x != "toxic"} | {"text": F.lit("t")})
    assert toxicity.scored(more, wide).count() == docs.count()
    assert quality.rated(more, wide).count() == docs.count()
    assert langid.identified(more).count() == docs.count()
    assert quality.kept(more, wide).columns == more.columns
    assert langid.kept(more).columns == more.columns


def test_repeated_rows_do_not_widen_the_sample(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    often = docs.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("n")
    ratings = quality.ratings(labels)
    assert np.allclose(quality.learn(often, ratings).weights, quality.learn(docs, ratings).weights)
    seen, fit = [], toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: (seen.append(len(y)), fit(x, y))[1])
    toxicity.learn(docs, labels)
    toxicity.learn(often, labels)
    assert seen[0] == seen[1] > 0


def test_shared_folder_of_a_cluster():
    from types import SimpleNamespace as Like

    from larder.llm.common import shared_dir

    sc = Like(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Like(sparkContext=sc, conf=Like(get=lambda key, default: default)))


def test_toxicity_edges(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert toxicity.scored(docs, labels).count() == len(ODD)
    none = toxicity.scored(docs, labels.where("false")).collect()
    assert {round(r["score"], 6) for r in none} == {0.0}
    assert toxicity.scored(docs.where("false"), labels).count() == 0
