"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= j) = sigmoid(w . x - c_j) for the thresholds c_1 < c_2 < ... of the grades, with one weight vector w for
all of them. x holds the shares of hashed byte trigrams and of hashed word shapes (case, first and last sign, whether the
word repeats the one before) in the whole text, drawn towards zero in short ones. The fit takes at most ``SAMPLE`` rated rows (those with the smallest hash of doc_id, whatever their number), and of
these, in the same order, as many whole texts as have ``FEATURES`` features together (one at least), so the driver holds at
most 12 bytes a feature while they arrive, 6 in the fit, and 50 for those of the rows at hand; the expected grade and the tail probability of every document follow from one pass.

A null or empty text has no features: its grade follows from the thresholds alone. Null ratings and ratings of
unknown documents are not learned from; repeated ratings of a document count once, the lowest, and of rows that
repeat a doc_id the least text is learned from. With fewer than two
grades to learn from every document gets that grade (0 if there is none). Rows come out one for one; other columns of
the documents and of the ratings are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE as SPACE
from .common import chunks, cut, filtered, in_batches, mixed, packed, run_hashes, runs, segment_sums, table
from .langid import held_out

#: Rated rows, and features of them together, that a fit takes at most, and those it works on at once.
SAMPLE, FEATURES, AT_ONCE = 6000, 1 << 25, 1 << 20
#: Hash buckets; rounds, rate and ridge of the fit; the tail probability from which a document is selected.
BUCKETS, ROUNDS, RATE, RIDGE, SELECT = 1 << 15, 200, 0.03, 1e-4, 0.5
#: Hash buckets of word shapes, which follow those of trigrams; trigrams and words by which a short text is drawn to zero; what is added to the spread of a feature.
SHAPES, SHORT_GRAMS, SHORT_WORDS, FLOOR = 1 << 10, 100, 20, 3e-4
ALL = BUCKETS + SHAPES


@dataclass(frozen=True)
class Model:
    grades: list[float]
    weights: np.ndarray
    cuts: np.ndarray


_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 2


def _buckets(part: np.ndarray) -> np.ndarray:
    """Buckets of the byte trigrams that start at each byte but the last two."""
    if len(part) < 3:
        return np.zeros(0, np.int64)
    code = part[:-2].astype(np.uint32) | (part[1:-1].astype(np.uint32) << 8) | (part[2:].astype(np.uint32) << 16)
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _shapes(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word's shape, and the words of each row."""
    starts, ends = runs(~SPACE[part], bounds)
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.int64), counts
    whole = run_hashes(part, starts, ends)[0]
    same = np.concatenate([[False], whole[1:] == whole[:-1]])
    at = np.cumsum(counts)[:-1]
    same[at[at < len(same)]] = False
    first, last = _KIND[part[starts]], _KIND[part[ends - 1]]
    caps = np.add.reduceat(_KIND[part] == 1, starts, dtype=np.int64)
    lows = np.add.reduceat(_KIND[part] == 2, starts, dtype=np.int64)
    mark = np.where(last == 0, part[ends - 1].astype(np.int64), 0)
    code = (first + 4 * last + 16 * np.minimum(caps, 2) + 48 * np.minimum(lows, 1) + 96 * np.minimum(ends - starts, 3)) * 256 + mark
    shape = 1 + (mixed(code.astype(np.uint64)) % np.uint64(SHAPES - 1)).astype(np.int64)
    return BUCKETS + np.where(same, 0, shape), counts  # a repeat has a bucket of its own


def features(docs: DataFrame) -> DataFrame:
    """id, y, and the distinct buckets and relative frequencies of text as binary arrays, for rows (text, y, id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share = [], []
            data, offsets = packed(batch.column(0))
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                grams, (shapes, _) = _buckets(data[a:b]), _shapes(data[a:b], np.array([0, b - a]))
                found, n = np.unique(np.concatenate([grams, shapes]), return_counts=True)
                at.append(found.astype("<u2").tobytes())
                share.append((n / np.where(found < BUCKETS, len(grams) + SHORT_GRAMS, len(shapes) + SHORT_WORDS)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int64()), batch.column(1).cast(pa.float64()), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["id", "y", "at", "share"])

    return docs.select("text", "y", "id").transform(in_batches, work, "id long, y double, at binary, share binary")


def fit(y: np.ndarray, at: np.ndarray, share: np.ndarray, sizes: np.ndarray, buckets: int = ALL) -> Model:
    """The model of rows with grades y; their features lie end to end in at (bucket) and share, ``sizes`` of them a row."""
    grades = np.unique(y)
    if len(grades) < 2:
        return Model(grades.tolist() or [0.0], np.zeros(buckets), np.zeros(0))
    ends = np.cumsum(sizes)
    edges = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(AT_ONCE, at.size, AT_ONCE), "right"), [len(y)]]))
    blocks = [(slice(i, j), slice(int(ends[i] - sizes[i]), int(ends[j - 1]))) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    total = lambda of: sum(np.bincount(at[b], of(a, b), buckets) for a, b in blocks)
    mean = total(lambda a, b: share[b]) / len(y)
    spread = np.sqrt(np.maximum(total(lambda a, b: share[b].astype(float) ** 2) / len(y) - mean**2, 0)) + FLOOR
    scale = 1 / spread / np.sqrt(200)
    tail = (y[:, None] >= grades[None, 1:]).astype(float)
    rate = np.clip(tail.mean(axis=0), 1e-3, 1 - 1e-3)
    steps = np.concatenate([[-np.log(rate[0] / (1 - rate[0]))], np.log(np.maximum(np.diff(-np.log(rate / (1 - rate))), 1e-2))])
    w = np.zeros(buckets)
    moments = [np.zeros(buckets), np.zeros(buckets), np.zeros(len(steps)), np.zeros(len(steps))]
    for t in range(1, ROUNDS + 1):
        cuts = steps[0] + np.concatenate([[0], np.cumsum(np.exp(steps[1:]))])
        v = w * scale
        z = np.concatenate([segment_sums(share[b] * v[at[b]], sizes[a]) for a, b in blocks])
        off = (1 / (1 + np.exp(np.clip(cuts - z[:, None], -30, 30))) - tail) / len(y)
        each = off.sum(axis=1)
        grad = scale * total(lambda a, b: share[b] * np.repeat(each[a], sizes[a])) + RIDGE * w  # noqa: B023
        down = -off.sum(axis=0)  # by the thresholds
        to_steps = np.concatenate([[down.sum()], [down[k:].sum() * np.exp(steps[k]) for k in range(1, len(steps))]])
        for value, g, m, v in ((w, grad, moments[0], moments[1]), (steps, to_steps, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    cuts = steps[0] + np.concatenate([[0], np.cumsum(np.exp(steps[1:]))])
    return Model(grades.tolist(), w * scale, cuts)


def _bytes(column: pa.Array) -> np.ndarray:
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if len(column) and edges[-1] > edges[0] else np.zeros(0, np.uint8)


def fitting(rows: DataFrame, most: int = FEATURES) -> DataFrame:
    """The first rows (id, at) by the hash of id that have ``most`` features together, and the first in any case."""
    keyed = rows.withColumn("key", F.xxhash64("id"))
    sizes = keyed.select("key", "id", (F.octet_length("at") / 2).cast("long").alias("n")).orderBy("key", "id").toArrow()  # three numbers a row of the sample
    room = max(int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), most, "right")), 1)
    if room < sizes.num_rows:
        key, last = sizes["key"][room].as_py(), sizes["id"][room].as_py()
        keyed = keyed.where((F.col("key") < key) | ((F.col("key") == key) & (F.col("id") < last)))
    return keyed.drop("key")


def learn(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` rows of ratings (doc_id, grade) and their texts in ``docs``."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("double").alias("y"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a bounded table, so it is broadcast
    texts = docs.select(F.col("doc_id").alias("_doc"), "text")  # no other column can clash
    texts = texts.join(F.broadcast(rated.withColumnRenamed("doc_id", "_id")), F.col("_doc") == F.col("_id")).groupBy("_id", "y").agg(F.min("text").alias("text"))  # however often an id is there
    rows = fitting(cut(features(texts.withColumnRenamed("_id", "id")))).toArrow()
    sizes = np.diff(np.concatenate([[0], np.cumsum(pc.binary_length(rows["at"]).to_numpy() // 2)]))
    at, share = (np.concatenate([np.zeros(0, kind), *[_bytes(x).view(kind) for x in rows[c].chunks]]) for c, kind in (("at", "<u2"), ("share", "<f4")))
    return fit(rows["y"].to_numpy(), at, share, sizes)


def judged(m: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The likeliest grade, expected grade and tail probability of every text of a column."""
    grades = np.array(m.grades)
    data, offsets = packed(column)
    z = np.zeros(len(offsets) - 1)
    for i, j, part, bounds in chunks(data, offsets):
        got = np.concatenate([[0.0], np.cumsum(m.weights[_buckets(part)]), [0.0, 0.0]])
        ends = np.maximum(bounds[1:] - 2, bounds[:-1])
        n = ends - bounds[:-1]
        last = max(len(part) - 2, 0)
        z[i:j] = np.where(n > 0, got[np.minimum(ends, last)] - got[np.minimum(bounds[:-1], last)], 0) / (n + SHORT_GRAMS)
        shapes, words = _shapes(part, bounds)
        z[i:j] += segment_sums(m.weights[shapes], words) / (words + SHORT_WORDS)
    tail = 1 / (1 + np.exp(np.clip(m.cuts[None, :] - z[:, None], -500, 500)))
    each = -np.diff(np.concatenate([np.ones((len(z), 1)), tail, np.zeros((len(z), 1))], axis=1), axis=1)
    return grades[np.argmax(each, axis=1)], each @ grades, tail[:, 0] if len(m.cuts) else np.full(len(z), float(grades[0] > 0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, grade (the likeliest), expected_grade and tail_prob, the probability of more than the lowest grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALL numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, judged(shared.value, batch.column(1)))], names=["doc_id", "grade", "expected_grade", "tail_prob"])

    return docs.select("doc_id", "text").transform(in_batches, work, "doc_id long, grade double, expected_grade double, tail_prob double")


def grade(quality: Column, toxic: Column) -> Column:
    """Grades from two labels: 0 low quality, 1 good but toxic, 2 good."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade of the labels that are not held out."""
    return labels.where(~held_out(5, 0)).select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions for all of ``docs`` by a model of the ratings that are not held out."""
    return predict(docs, learn(docs, ratings(labels)))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are likelier above the lowest grade than in it; all of them if nothing can be learned."""
    model = learn(docs, ratings(labels))
    if not len(model.cuts):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda column: judged(shared.value, column)[2] >= SELECT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "grade", "expected_grade", "tail_prob", (F.col("tail_prob") >= SELECT).cast("int").alias("selected"))
