"""Toxicity behind a noisy channel: Viterbi decoding restores obfuscated words, then the restored text is scored.

Character language model: smoothed log probabilities of a byte given the byte before, within lower-case words,
counted over all texts. Suspicious spans (words of letters and imitating signs, letters set apart one by one, groups
of up to three letters that are likelier as one word, doubled letters, Latin words with letters of other scripts that
look like Latin ones, full-width letters or marks without width) become character lattices: each written sign may stand for itself or for the letters it imitates, a
separator, a mark without width or a repeat may stand for nothing, each at a channel cost. Viterbi finds the likeliest
letters. A word wholly of another script is that script's and stays as written.

Word model: for hashed words, their first bytes and their lengthwise prefixes, the number of toxic and of other
documents that hold them, over all rows whose label may be learned. A document's features are the largest log odds of
its words, restored ones included, their number beyond thresholds and their density; a logistic regression on a
bounded sample makes them a probability.

Null and empty texts have no words and score the base rate of the model. Null labels, and labels of unknown
documents, are not learned from; of several labels of a document the highest counts, and of rows
that repeat a doc_id the regression takes the least text. Without both classes every score
is the share of the one there is (0 without any). Texts are taken whole. Rows come out one for one, repeated ones too;
columns other than doc_id and text of the documents, doc_id and toxic of the labels, are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LETTER as LETTER
from .common import chunks, in_batches, lower, packed, run_hashes, runs, sized, table
from .langid import held_out

#: Hash buckets of word features, bytes of the prefixes that are features, labelled rows that the regression takes at most, and restored spans kept in a worker.
BUCKETS, PREFIXES, SAMPLE, CACHE = 1 << 19, (4, 5, 6), 6000, 1 << 16
#: What written signs may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
SEPARATORS = " .-_*~"
#: Cyrillic, then Greek letters that look like Latin ones, and marks without width.
LOOKS = {
    **dict(zip("аеорсухіјѕһԁԛԝкт", "aeopcyxijshdqwkt", strict=True)),
    **dict(zip("АВЕКМНОРСТУХІЈЅ", "abekmhopctyxijs", strict=True)),
    **dict(zip("αονιρκτυχ", "aovipktux", strict=True)),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abezhikmnoptyx", strict=True)),
    **{chr(first + i): chr(97 + i) for first in (0xFF21, 0xFF41) for i in range(26)},  # full-width
}
WIDTHLESS = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Signs that may also be punctuation at the edge of a word.
EDGE = "!|(+"
#: Natural-log costs: of a sign read as a letter, of one kept, of a dropped separator, of a letter dropped beside its like.
IMITATE, KEEP, DROP, REPEAT = -0.7, -6.0, -0.2, -0.4
_LEET = np.zeros(256, bool)
_LEET[[ord(x) for x in SIGNS]] = True
_LIKE = np.arange(256)
_LIKE[[ord(x) for x in SIGNS]] = [ord(x[0]) for x in SIGNS.values()]
_APART = np.zeros(256, bool)
_APART[[ord(x) for x in SEPARATORS]] = True
_ALIKE = np.zeros(1 << 16, bool)
_ALIKE[[ord(x) for x in (*LOOKS, *WIDTHLESS)]] = True


def bigrams(docs: DataFrame) -> np.ndarray:
    """256 x 256 log probabilities of the next byte in a word (32 before its first and after its last), over all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            data, offsets = packed(batch.column(0))
            for _, _, part, _ in chunks(data, offsets):
                flat = np.where(LETTER[part], lower(part), 32).astype(np.int64)
                total += np.bincount(flat[:-1] * 256 + flat[1:], minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    counts = np.zeros(65536)
    found = docs.select("text").transform(in_batches, work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    counts[found["pair"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(256, 256)
    counts[32, 32] = 0
    return np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 25.6))


def restore(span: str, lm: np.ndarray) -> str:
    """The likeliest letters of a written span: a Viterbi pass whose state is the last letter restored.

    A path is its cost and a chain of what was read, so time and memory are in proportion to the span.
    """
    paths: dict[int, tuple[float, tuple | None]] = {32: (0.0, None)}
    inner = len(span) - len(span.lstrip(EDGE)), len(span.rstrip(EDGE))
    latin = any("a" <= x.lower() <= "z" or x >= "\uff21" and x in LOOKS for x in span)
    for k, sign in enumerate(span):
        raw = sign.encode()
        reads: list[tuple[bytes, float]] = []
        if sign in SEPARATORS:
            reads.append((b"", DROP))
        elif latin and sign in WIDTHLESS:
            reads.append((b"", 0.0))
        elif sign in SIGNS:
            reads += [(x.encode(), IMITATE) for x in SIGNS[sign]] + [(raw, KEEP)]
            if k + 1 < len(span) and span[k + 1] == sign:
                reads.append((b"", REPEAT))
            elif sign in EDGE and not inner[0] <= k < inner[1]:
                reads.append((b"", DROP))
        else:
            reads.append((raw, 0.0))
            if latin and sign in LOOKS:
                reads.append((LOOKS[sign].encode(), IMITATE))
            if k and span[k - 1] == sign:
                reads.append((b"", REPEAT))
        after: dict[int, tuple[float, tuple | None]] = {}
        for last, (cost, made) in paths.items():
            for read, channel in reads:
                value, state = cost + channel, last
                for byte in read:
                    value += lm[state, byte]
                    state = byte
                if state not in after or value > after[state][0]:
                    after[state] = (value, (made, read) if read else made)
        paths = after
    chain = max(((cost + lm[last, 32], made) for last, (cost, made) in paths.items()), key=lambda x: x[0])[1]
    parts: list[bytes] = []
    while chain is not None:
        chain, read = chain
        parts.append(read)
    return b"".join(reversed(parts)).decode(errors="replace")


def _imitated(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which spans hold look-alike signs among Latin letters."""
    lead = np.flatnonzero((part >= 0xC2) & (part < 0xF0))
    lead = lead[lead + np.where(part[lead] < 0xE0, 1, 2) < len(part)]
    if not len(lead):
        return np.zeros(len(starts), bool)
    first, second, third = (part[np.minimum(lead + k, len(part) - 1)].astype(np.int64) & 63 for k in range(3))
    code = np.where(part[lead] < 0xE0, (first & 31) << 6 | second, (first & 15) << 12 | second << 6 | third)
    hit, latin = np.zeros(len(part), bool), LETTER[part] & (part < 128)
    hit[lead] = _ALIKE[code]
    latin[lead] |= hit[lead] & (code >= 0xFF21) & (code <= 0xFF5A)
    signs, own = (np.concatenate([[0], np.cumsum(x)]) for x in (hit, latin))
    return (signs[ends] > signs[starts]) & (own[ends] > own[starts])


def suspicious(part: np.ndarray, bounds: np.ndarray, lm: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a chunk's spans to restore: words of letters and imitating or look-alike signs or with doubled letters, letters set apart one by one, and groups of up to three letters.

    Of neighbouring groups those are one span that ``lm`` finds likelier joined than apart. A bigram model decides each
    gap by the letters beside it, so this is what a lattice over all gaps would find.
    """
    none = np.zeros(0, np.int64)
    if len(part) < 3:
        return none, none
    letter, leet, apart = LETTER[part], _LEET[part], _APART[part]
    starts, ends = runs(letter | leet, bounds)
    if not len(starts):
        return none, none
    low = lower(part)
    hit = leet.copy()
    hit[:-1] |= letter[:-1] & (low[:-1] == low[1:]) & (part[:-1] < 128)
    seen = np.concatenate([[0], np.cumsum(hit)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    take = ((seen[ends] > seen[starts]) | _imitated(part, starts, ends)) & (letters[ends] > letters[starts]) & (ends - starts > 1)
    found = [(starts[take], ends[take])]
    # groups with nothing but separators between
    chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    size = chars[ends] - chars[starts]
    gaps = np.concatenate([[0], np.cumsum(~apart)])
    near = np.zeros(len(starts), bool)
    near[:-1] = (gaps[starts[1:]] == gaps[ends[:-1]]) & (starts[1:] > ends[:-1])
    row = np.searchsorted(bounds, starts, "right")
    near[:-1] &= row[1:] == row[:-1]
    single, group = near.copy(), near.copy()
    single[:-1] &= (size[:-1] == 1) & (size[1:] == 1)
    group[:-1] &= (size[:-1] <= 3) & (size[1:] <= 3)
    if lm is not None:
        last, first = _LIKE[low[ends[:-1] - 1]], _LIKE[low[starts[1:]]]
        group[:-1] &= lm[last, first] + DROP > lm[last, 32] + lm[32, first]
    every, total = np.array([0, len(starts)]), np.concatenate([[0], np.cumsum(size)])
    for joined, least in ((single, 3), (group, 4)):
        a, b = runs(joined, every)
        if len(a):
            widest = np.maximum.reduceat(size, np.stack([a, np.minimum(b + 1, len(size) - 1)], axis=1).ravel())[::2]
            widest = np.maximum(widest, size[b])  # where the last group ends the chunk
            take = (total[b + 1] - total[a] >= least) & (letters[ends[b]] - letters[starts[a]] >= 2) & ((least == 3) | (widest > 1))
            found.append((starts[a[take]], ends[b[take]]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _restored(part: np.ndarray, bounds: np.ndarray, lm: np.ndarray, cache: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The restored words of a chunk as texts with spaces between, and the offsets of its rows in them.

    A lattice without signs has one state at every place, the letter before, so each separator and repeat is decided
    alone and all such spans at once; the others are decoded one by one.
    """
    start, end = suspicious(part, bounds, lm)
    if not len(start):
        return
    low = lower(part)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    row = np.searchsorted(bounds, start, "right") - 1
    signs = np.concatenate([[0], np.cumsum(_LEET[part] | _twice(low))])
    hard = (signs[end] > signs[start]) | _imitated(part, start, end)

    gone = LETTER[part] & (part < 128) & (lm[low, low] < REPEAT)
    gone[1:] &= low[1:] == low[:-1]
    gone[bounds[:-1][bounds[:-1] < len(part)]] = False
    gone |= _APART[part]
    lost = np.concatenate([[0], np.cumsum(gone)])
    plain = ~hard & (lost[end] > lost[start])
    if plain.any():
        a, size = start[plain], (end - start)[plain]
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text = np.where(gone[at], 0, low[at])
        text = np.insert(text, np.cumsum(size), 32)  # a space after each span
        left = text > 0
        spans = np.bincount(row[plain], minlength=len(bounds) - 1)
        spaced = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(spans)])]
        yield text[left].astype(np.uint8), np.concatenate([[0], np.cumsum(left)])[spaced]

    rows: list[list[bytes]] = [[] for _ in range(len(bounds) - 1)]
    flat = low.tobytes()
    for a, b, of in zip(start[hard].tolist(), end[hard].tolist(), row[hard].tolist(), strict=True):
        raw = flat[a:b]
        found = cache.get(raw)
        if found is None:
            found = restore(raw.decode(errors="replace"), lm).encode()
            if len(raw) <= 64:  # longer spans hardly come again
                if len(cache) >= CACHE:
                    cache.clear()
                cache[raw] = found
        if found != raw:
            rows[of].append(found)
    texts = [b" ".join(x) for x in rows]
    yield np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def _twice(low: np.ndarray) -> np.ndarray:
    """Where a character of several bytes follows its like."""
    out = np.zeros(len(low), bool)
    for lead, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero((low >= lead) & (low < lead + (32 if size == 2 else 16)))
        at = at[at + 2 * size <= len(low)]
        same = np.ones(len(at), bool)
        for k in range(size):
            same &= low[at + k] == low[at + size + k]
        out[at[same] + size] = True
    return out


def _words(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words x features) and rows of the words of a chunk; a word without a prefix of that length repeats its own bucket."""
    starts, ends = runs(LETTER[part], bounds)
    whole, *heads = run_hashes(lower(part), starts, ends, PREFIXES)
    cols = [whole, *[np.where(h == 0, whole, h) for h in heads]]
    shift = np.uint64(64 - 19)
    return np.stack([(x >> shift).astype(np.int64) for x in cols], axis=1), np.searchsorted(bounds, starts, "right") - 1


def _both(part: np.ndarray, bounds: np.ndarray, lm: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """As _words, of the written and then the restored words."""
    found = [_words(part, bounds), *[_words(extra, at) for extra, at in _restored(part, bounds, lm, cache) if len(extra)]]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def word_odds(docs: DataFrame, lm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of every bucket from the documents (text, toxic, half) that hold it: by those of half 1, and by all; one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(lm)
    names = ["n00", "n01", "n10", "n11"]  # half, toxic

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size, cache = np.zeros((4, BUCKETS), np.int32), np.zeros(4, np.int64), {}
        for batch in batches:
            kind = 2 * batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + (batch.column(1).to_numpy(zero_copy_only=False) > 0)
            size += np.bincount(kind, minlength=4)
            data, offsets = packed(batch.column(0))
            for i, j, part, bounds in chunks(data, offsets):
                buckets, row = _both(part, bounds, shared.value, cache)
                held = np.unique((row[:, None] * BUCKETS + buckets).ravel())
                of = kind[i:j][held >> 19]
                for c in range(4):
                    total[c] += np.bincount(held[of == c] & (BUCKETS - 1), minlength=BUCKETS).astype(np.int32)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), *[pa.array(np.append(total[c][at], size[c]).astype(np.int64)) for c in range(4)]], names=["bucket", *names])

    found = docs.select("text", "toxic", "half").transform(in_batches, work, "bucket int, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    found = found.where("n01 + n11 > 1 or bucket < 0").toArrow()  # BUCKETS rows at most
    bucket = found["bucket"].to_numpy()
    real, table4 = bucket >= 0, np.stack([found[n].to_numpy() for n in names])

    def odds(of: np.ndarray) -> np.ndarray:
        n, size = np.zeros((2, BUCKETS)), of[:, ~real].sum(axis=1)
        n[:, bucket[real]] = of[:, real]
        value = np.log((n[1] + 0.02) / (size[1] + 1)) - np.log((n[0] + 0.5) / (size[0] + 1))
        return np.where(n[1] > 1, np.maximum(value, 0), 0).astype(np.float32)

    return odds(table4[2:]), odds(table4[:2] + table4[2:])


def _features(value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Of the word values of a chunk: the two largest, how many pass 1, 2 and 3, their density, and whether there are words."""
    out = np.zeros((n, 7))
    words = np.bincount(row, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row, value)
    out[:, 0] = top
    is_top = value >= top[row]
    spare = np.bincount(row[is_top], minlength=n) > 1
    second = np.zeros(n)
    np.maximum.at(second, row[~is_top], value[~is_top])
    out[:, 1] = np.where(spare, top, second)
    for k, t in enumerate((1.0, 2.0, 3.0)):
        out[:, 2 + k] = np.log1p(np.bincount(row[value > t], minlength=n))
    out[:, 5] = np.log1p(1000 * np.bincount(row[value > 2], minlength=n) / np.maximum(words, 1))
    out[:, 6] = np.log1p(words) / 10
    return out


@dataclass(frozen=True)
class Model:
    lm: np.ndarray
    odds: np.ndarray
    weights: np.ndarray
    bias: float


def measured(docs: DataFrame, columns: list[str], lm: np.ndarray, odds: np.ndarray) -> DataFrame:
    """The columns (long) beside text, and x, the features of the whole text with its restored words."""
    shared = docs.sparkSession.sparkContext.broadcast((lm, odds))  # fixed sizes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm, odds = shared.value
        cache: dict = {}
        for batch in batches:
            x = np.zeros((batch.num_rows, 7))
            data, offsets = packed(batch.column(0))
            for i, j, part, bounds in chunks(data, offsets):
                buckets, row = _both(part, bounds, lm, cache)
                if len(row):
                    x[i:j] = _features(odds[buckets].max(axis=1), row, j - i)
            yield pa.RecordBatch.from_arrays([*[batch.column(1 + k).cast(pa.int64()) for k in range(len(columns))], pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*columns, "x"])

    return docs.select("text", *columns).transform(in_batches, work, ", ".join(f"{c} long" for c in columns) + ", x array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(x.shape[1] if x.ndim > 1 else 7), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20))
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / len(y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / len(y) + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labels (doc_id, toxic): the language model on all texts, word odds on all labelled ones, the regression on a sample.

    Odds for the sample's documents come from the other half of the labelled rows, so that rare words that
    one document alone makes look toxic do not mislead the regression.
    """
    docs = docs.select(F.col("doc_id").alias("_doc"), "text")  # no other column can clash
    lm = bigrams(docs)
    half = (F.pmod(F.xxhash64("_id"), F.lit(2)) != 0).cast("int")
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = sized(marked.withColumn("half", half))
    other, odds = word_odds(docs.join(marked, F.col("_doc") == F.col("_id")).select("text", "toxic", "half"), lm)
    sample = marked.where("half = 0").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    texts = docs.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).groupBy("_id", "toxic").agg(F.min("text").alias("text"))  # however often an id is there
    fit = measured(texts, ["toxic"], lm, other).toArrow()
    x = np.array(fit["x"].to_pylist(), float).reshape(-1, 7)
    weights, bias = logistic(x, fit["toxic"].to_numpy().clip(0, 1).astype(float))
    return Model(lm, odds, weights, bias)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    found = measured(docs, ["doc_id"], model.lm, model.odds)
    z = F.lit(model.bias)
    for k, w in enumerate(model.weights.tolist()):
        z = z + F.col("x")[k] * w
    return found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores for all of ``docs`` by a model of the labels that are not held out."""
    return predict(docs, learn(docs, labels.where(~held_out(5, 0)).select("doc_id", "toxic")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
