"""Language identification by inference of a mixture of languages in each document.

Each learned language has an n-gram model: smoothed log probabilities of hashed byte 4-grams (lower case, word
ends as spaces). A word is a run of letters with their marks, as Unicode has them. Its likelihood under a language is the product over its n-grams. Each document is a mixture:
expectation-maximisation over its words estimates the proportion of every language, and of the nested sets of the
k most likely languages the one with the best penalised likelihood is the document's language set.

A text that is null, empty or without a letter (digits and signs of any script) is ``und`` with score 0. A null lang is
not learned from. Without any learned language every text is ``und``. Texts are taken whole, long ones in parts (a word
goes on in the next only where it is longer than a part) whose distinct words are counted, so that a document's memory
is in proportion to its distinct words. Ties between languages go to the first in alphabetical order. Rows come out one
for one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filtered, in_batches, letters, lower, packed, parts, run_hashes, runs, segment_sums, table

#: Hash buckets of a language's n-grams, pseudo-count of a bucket, EM rounds, cost of a language in units of ln(words), and languages that are counted or scored at once.
BUCKETS, PSEUDO, ROUNDS, PENALTY, BLOCK = 1 << 16, 0.5, 8, 4.0, 64


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages, float32


def _grams(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a chunk, one for each letter byte; the words' sizes in bytes and their starts."""
    kind = letters(part)
    letter = kind > 0
    starts, ends = runs(letter, bounds)
    if len(starts) and (bare := np.maximum.reduceat(kind, starts) < 2).any():  # marks without a letter are no word
        for a, b in zip(starts[bare].tolist(), ends[bare].tolist(), strict=True):
            letter[a:b] = False
        starts, ends = starts[~bare], ends[~bare]
    flat = np.where(letter, lower(part), 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    wide = np.concatenate([np.full(1, 32, np.uint32), flat, np.full(3, 32, np.uint32)])
    first = np.zeros(len(part), bool)
    first[starts] = True
    # one byte before (a space at a word's start) to two after, cut at the word's end
    end_of = np.repeat(ends, ends - starts)
    before = np.where(first[at], 32, wide[at])
    second = np.where(at + 1 < end_of, wide[at + 2], 32)
    third = np.where(at + 2 < end_of, wide[at + 3], np.where(at + 1 < end_of, 32, 0))
    code = (before | (wide[at + 1] << 8) | (second << 16) | (third << 24)).astype(np.uint32)
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return bucket, ends - starts, starts


def learn(docs: DataFrame) -> Model:
    """N-gram models of every non-null lang, from all rows of ``docs``: one count table a language."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())  # names of languages
    dense = len(langs) <= BLOCK
    index = {x: i for i, x in enumerate(langs)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs) if dense else 0, BUCKETS), np.int64)

        def rows_of(lang: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

        for batch in batches:
            lang = np.array([index.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            data, offsets = packed(batch.column(1))
            for i, j, part, bounds, _ in parts(data, offsets):
                bucket, sizes, starts = _grams(part, bounds)
                word = np.searchsorted(bounds, starts, "right") - 1
                of = np.repeat(lang[i:j][word], sizes)
                known = of >= 0
                code = of[known] * BUCKETS + bucket[known]
                if dense:
                    total += np.bincount(code, minlength=total.size).reshape(total.shape)
                else:
                    seen, n = np.unique(code, return_counts=True)
                    yield rows_of(seen // BUCKETS, seen % BUCKETS, n)
        at, where = np.nonzero(total)
        yield rows_of(at, where, total[at, where])

    logp = np.zeros((BUCKETS, len(langs)), np.float32)
    if langs:
        found = rows.transform(in_batches, work, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # the n-grams of each language, at most BUCKETS
        lang, bucket, n = (found[c].to_numpy() for c in ("lang", "bucket", "n"))
        for i in range(0, len(langs), BLOCK):
            here = (lang >= i) & (lang < i + BLOCK)
            counts = np.zeros((BUCKETS, min(BLOCK, len(langs) - i)))
            counts[bucket[here], lang[here] - i] = n[here]
            logp[:, i : i + BLOCK] = np.log((counts + PSEUDO) / (counts.sum(axis=0) + PSEUDO * BUCKETS))
    return Model(langs, logp)


def mixtures(word_ll: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (documents x languages, 0 outside the chosen set), sizes of the sets, and log-likelihoods by one language alone.

    word_ll: log-likelihood of every word in every language; counts: words of each document, in order; weight: how often
    each word is there (once).
    """
    n, k = len(counts), word_ll.shape[1]
    weighed = (lambda x: x) if weight is None else (lambda x: x * (weight[:, None] if x.ndim > 1 else weight))
    alone = segment_sums(weighed(word_ll.astype(np.float64)), counts)
    top = word_ll.max(axis=1, keepdims=True)
    like = np.exp(word_ll - top)
    base = segment_sums(weighed(top[:, 0].astype(np.float64)), counts)
    doc = np.repeat(np.arange(n), counts)
    total = counts if weight is None else segment_sums(weight.astype(np.float64), counts)
    words = np.maximum(total, 1)[:, None]

    def em(at: np.ndarray, allowed: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the documents ``at``: proportions of the allowed languages, log-likelihoods."""
        own = np.zeros(n, bool)
        own[at] = True
        near, sizes, times = (like, counts, weight) if len(at) == n else (like[own[doc]], counts[at], None if weight is None else weight[own[doc]])
        of = np.repeat(np.arange(len(at)), sizes)
        share = np.where(allowed, start + 1e-3, 0)
        share = (share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        for _ in range(ROUNDS):
            part = share[of] * near
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            if times is not None:
                part *= times[:, None]
            share = (segment_sums(part, sizes) / words[at]).astype(np.float32)
            share = np.where(allowed & (share < 1e-6), 1e-6, share)
        each = np.log(np.maximum((share[of] * near).sum(axis=1), 1e-30)).astype(np.float64)
        return share, segment_sums(each if times is None else each * times, sizes) + base[at]

    first = np.argmax(alone, axis=1)
    share = np.zeros((n, k), np.float32)
    share[np.arange(n), first] = 1
    best, size = alone[np.arange(n), first], np.ones(n, np.int64)
    if k > 1 and n:
        full, fit = em(np.arange(n), np.ones((n, k), bool), np.full((n, k), 1 / k))
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        # no mixture fits better: by the gradient of the log-likelihood, which is concave, and by each word's best language
        mix = np.maximum((full[doc] * like).sum(axis=1, keepdims=True), 1e-30)
        slope = segment_sums(weighed((like / mix).astype(np.float64)), counts).max(axis=1)
        limit = np.minimum(base, fit + slope - total) + 1e-3 + total * (2e-6 * k + 1e-5)
        for m in range(2, k + 1):
            cost = PENALTY * (m - 1) * np.log(words[:, 0] + 1)
            at = np.flatnonzero(limit - cost > best)
            if not len(at):
                break
            now, fit = em(at, rank[at] < m, full[at])
            better = fit - cost[at] > best[at]
            at, now, fit = at[better], now[better], fit[better]
            share[at], best[at], size[at] = now, fit - cost[at], m
    return share, size, alone


def _distinct(name: np.ndarray, word_ll: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word once: its hash, its log-likelihoods and how often it is there."""
    name, first, of = np.unique(name, return_index=True, return_inverse=True)
    return name, word_ll[first], np.bincount(of, weight, len(name))


def judged(m: Model, column: pa.Array) -> tuple[list, list, list, list, list]:
    """lang_pred, score, n_langs and shares of every text of a column, and by how much an n-gram is likelier in the language set than if all buckets were alike (nats; 0 without a letter)."""
    names = np.array([*m.langs, "und"], dtype=object)
    data, offsets = packed(column)
    pred, score, size, sets, gain = [], [], [], [], []

    def settle(word_ll: np.ndarray, counts: np.ndarray, weight: np.ndarray | None, letter: np.ndarray) -> None:
        n = len(counts)
        total = counts if weight is None else segment_sums(weight, counts)
        share, k, alone = mixtures(word_ll, counts, weight)
        most = np.argmax(share, axis=1)
        gap = alone - alone[np.arange(n), most][:, None]
        sure = 1 / np.exp(np.minimum(gap / np.sqrt(np.maximum(total, 1))[:, None], 0)).sum(axis=1)
        none = counts == 0
        most[none] = len(m.langs)
        pred.extend(names[most].tolist())
        score.extend(np.where(none, 0, np.clip(share.max(axis=1) * sure, 0, 1)).astype(float).tolist())
        size.extend(np.where(none, 0, k).tolist())
        sets.extend("" if z else " ".join(f"{m.langs[i]}:{x[i]:.3f}" for i in np.argsort(-x, kind="stable")[:c]) for z, x, c in zip(none, share, k, strict=True))
        top = word_ll.max(axis=1)
        fit = np.log(np.maximum((np.repeat(share, counts, axis=0) * np.exp(word_ll - top[:, None])).sum(axis=1), 1e-30)).astype(np.float64) + top
        gain.extend(np.where(none, 0, segment_sums(fit if weight is None else fit * weight, counts) / np.maximum(letter, 1) + np.log(BUCKETS)).tolist())

    held: tuple | None = None
    for i, j, part, bounds, ends in parts(data, offsets, (1 << 20) * BLOCK // max(BLOCK, len(m.langs))):
        if not m.langs:
            pred, score, size, sets, gain = ([*x, *[y] * (j - i) * ends] for x, y in ((pred, "und"), (score, 0.0), (size, 0), (sets, ""), (gain, 0.0)))
            continue
        bucket, sizes, starts = _grams(part, bounds)
        word_ll = np.concatenate([segment_sums(m.logp[:, x : x + BLOCK][bucket], sizes) for x in range(0, len(m.langs), BLOCK)], axis=1).astype(np.float32)
        counts = np.diff(np.searchsorted(starts, bounds))
        if ends and held is None:
            settle(word_ll, counts, None, segment_sums(sizes, counts))
            continue
        seen = _distinct(run_hashes(lower(part), starts, starts + sizes)[0], word_ll, np.ones(len(starts)))
        letter = int(sizes.sum())
        if held is not None:
            seen, letter = _distinct(*(np.concatenate(x) for x in zip(held[0], seen, strict=True))), letter + held[1]
        held = seen, letter
        if ends:
            settle(seen[1], np.array([len(seen[0])]), seen[2], np.array([letter]))
            held = None
    return pred, score, size, sets, gain


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the predicted language's share times its posterior among single languages), n_langs and the shares of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, size, sets, _ = judged(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int32()), pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "n_langs", "shares"])

    return docs.select("doc_id", "text").transform(in_batches, work, "doc_id long, lang_pred string, score double, n_langs int, shares string")


def held_out(buckets: int, left: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``left``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets == left, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Predictions for all of ``docs`` by a model learned from those that are not held out."""
    return predict(docs, learn(docs.where(~held_out(4, 2))))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in some languages: rejected are ``und`` and texts that their own language set explains worse than n-grams drawn evenly; how many languages share a text does not matter."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs.where(~held_out(4, 2))))

    def judge(column: pa.Array) -> np.ndarray:
        pred, _, _, _, gain = judged(shared.value, column)
        return np.array([p != "und" and g > 0 for p, g in zip(pred, gain, strict=True)], bool)

    return filtered(docs, judge)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identified(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "n_langs", "shares")
