"""Stored text indexes: immutable segments, deletions by document, merging by size, and searches that skip blocks.

A segment holds the words of some documents: a row for each word of a document (token, id, how often, how long the
document is, where), after a row for each document (without a token, in the first bucket), by bucket and token, and within a token by block of documents. Documents of about one length
share a block, and for each word of a block the most occurrences and the least length are stored: they bound what
the word can score there. A document that changes or goes is noted beside the segments with the one that holds it,
and its new text is in the segment of the change; so a change writes what it changes. Segments of a like size are
merged when there are ``MERGE`` of them, so that a document is rewritten about log n times, and what is noted about
documents of merged segments goes.

A segment of new documents is made by tasks that each take some documents whole: they sort the words of theirs, share
their documents out to blocks and write words, bounds and lengths at once. So the texts are dealt, not their words.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Change, Snapshot
from ..sources.shared import settled

#: BM25's constants and least idf.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# Latin letters with marks, and the letters without.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
FIELDS = ("title", "notes", "filename", "caption", "tags")
#: Most folders of a segment's postings, by hash of the token, and the documents of a segment for each of them.
BUCKETS, PER_BUCKET = 16, 2048
#: Words that a worker counts at once, that a task sorts, bytes of a word, with the space behind it, that a number of tasks reckons with, and rows that a worker hands over at once.
WORDS, PER_TASK, BYTES, ROWS = 500_000, 4_000_000, 6, 100_000
#: Documents of a block, steps of a doubling of length that may share one, and rows of a page of a file, which is what a search skips.
BLOCK, STEPS, PAGE = 512, 4, 2000
#: Segments of a like size that are merged, and how many times larger the next size is.
MERGE = 4
#: Blocks that a filter names; more are joined. Best documents that a search keeps by itself; for more, all hits are scored.
NAMED, MOST = 2048, 10_000
#: Documents that are gone which are broadcast to the words; beyond that both are shuffled, without a sort of all words.
HELD = 200_000
#: Decimals of a score that count in an order, so that ties do not hang on the order in which Spark adds.
PLACES = 9
NAME = "text"
_PLACES = "array<bigint>"  # the field's number in its segment in the upper half, the place in the lower
_WORDS = f"token string, block bigint, id bigint, n bigint, length double, places {_PLACES}, bucket int"
_BOUNDS = "token string, block bigint, id bigint, n bigint, length double, bucket int"  # documents, most occurrences and least length of a word's block
_DOCS = "id bigint, length double, block bigint"
_ROWS = f"kind string, bucket int, token string, block bigint, id bigint, n bigint, length double, places {_PLACES}"
_GONE = "segment bigint, id bigint, length double, block bigint"


def _plain(c):
    """Text in lower case without marks."""
    text = F.lower(F.col(c) if isinstance(c, str) else c)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, MARKED, PLAIN))  # ASCII has no marks


def tokens(c):
    """Lower-case words without marks, in order."""
    return F.regexp_extract_all(_plain(c), F.lit(r"([\p{L}\p{N}]+)"))


def spaced(c):
    """The same words as one text, with a space between any two."""
    return F.trim(F.regexp_replace(_plain(c), r"[^\p{L}\p{N}]+", " "))


def postings(docs: DataFrame, fields: tuple[str, ...] | list[str] = FIELDS) -> DataFrame:
    """(id, field, pos, token) of every word of every field; nulls have none."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(f).alias("words")) for f in fields])).alias("f")
    return docs.select("id", each).select("id", "f.field", F.posexplode("f.words").alias("pos", "token"))


def phrases(spark, words: list[str]) -> list[list[str]]:
    """The tokens of each query word, by the same rules as documents; words without any are left out.

    A word of several tokens is a phrase. The query is a literal, so its tokens come from one row.
    """
    row = spark.range(1).select(*[tokens(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words)]).first() if words else []
    return [list(x) for x in row if x]


def occurrences(post: DataFrame, phrase: list[str]) -> DataFrame:
    """(id, n): how often a phrase occurs in a document, within one field."""
    if len(phrase) == 1:
        return post.where(F.col("token") == phrase[0]).groupBy("id").agg(F.count("*").alias("n"))
    want = F.array(*[F.lit(t) for t in phrase])
    hits = post.where(F.col("token").isin(*phrase)).select("id", "field", F.explode(F.filter(F.transform(want, lambda t, i: F.when(t == F.col("token"), F.col("pos") - i)), lambda x: x.isNotNull())).alias("start"), "pos")
    return hits.groupBy("id", "field", "start").agg(F.countDistinct("pos").alias("m")).where(F.col("m") == len(phrase)).groupBy("id").agg(F.count("*").alias("n"))


def part(n: Column | float, length: Column | float, mean: Column | float):
    """What a word adds to a score, but for its idf: more occurrences add more, a longer document less."""
    return n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))


class TextIndex:
    """The words of documents, found anew wherever they are used."""

    def __init__(self, docs: DataFrame, fields: tuple[str, ...] | list[str] | None = None) -> None:
        self.fields = [f for f in fields or FIELDS if f in docs.columns]
        self.sparkSession, self._words = docs.sparkSession, docs.select("id", *[F.coalesce(tokens(f), F.array().cast("array<string>")).alias(f) for f in sorted(self.fields)])
        self._texts = docs.select(F.col("id").cast("bigint").alias("id"), *[F.coalesce(spaced(f), F.lit("")).alias(f) for f in sorted(self.fields)])
        size = reduce(Column.__add__, [F.size(f) for f in self.fields], F.lit(0)).cast("double")
        self.posting, self.lengths = postings(docs, self.fields), self._words.select("id", size.alias("length"))

    def sorted_words(self) -> DataFrame:
        """(id, length, first, token, places): the words of each document by token, with their places by field, the field's number in the upper half of each.

        ``first`` marks one row of each document; a document without words has that row alone, without a token.
        """
        return self._words.mapInArrow(_runs, f"id {self._words.schema['id'].dataType.simpleString()}, length double, first boolean, token string, places array<bigint>")

    def texts(self) -> DataFrame:
        """(id, the words of each field in order of the fields' names with a space between, bytes): the documents as a segment is made of them."""
        return self._texts.withColumn("_bytes", reduce(Column.__add__, [F.octet_length(f) for f in self.fields], F.lit(0)))

    @staticmethod
    def of(docs: DataFrame | TextIndex, fields: tuple[str, ...] | list[str] | None = None) -> TextIndex:
        """An index of documents; one that is there stays as it is."""
        return docs if isinstance(docs, TextIndex) else TextIndex(docs, fields)

    def of_tokens(self, words: list[str]) -> DataFrame:
        """Postings (id, field, pos, token) of some tokens."""
        return self.posting.where(F.col("token").isin(*words))

    def totals(self) -> DataFrame:
        """One row: docs and mean, the number of documents and their mean length."""
        return self.lengths.agg(F.count("*").cast("double").alias("docs"), F.avg("length").alias("mean"))

    def hits(self, found: list[list[str]]) -> DataFrame:
        """(id, i, n, length): how often document id holds the i-th phrase."""
        post = self.of_tokens(sorted({t for p in found for t in p}))
        every = reduce(DataFrame.union, [occurrences(post, p).select("id", F.lit(i).alias("i"), "n") for i, p in enumerate(found)])
        return every.join(self.lengths, "id")

    def store(self, catalog: Catalog, buckets: int = BUCKETS) -> Segments:
        """Write the index as the one segment of a catalogue's text index."""
        change = catalog.begin()
        change.name(NAME, [])
        add_segment(change, self, buckets)
        return Segments(change.commit())


class Segments(TextIndex):
    """A stored index, as a snapshot of a catalogue names it; searches read what they need of each segment."""

    def __init__(self, snapshot: Snapshot | Change) -> None:
        self.snapshot = snapshot.now() if isinstance(snapshot, Change) else snapshot
        self.sparkSession = snapshot.spark
        self.segments = [p for p in self.snapshot.parts(NAME) if p["kind"] == "segment"]
        self.notes = [p for p in self.snapshot.parts(NAME) if p["kind"] == "gone"]

    def _each(self, below: str, schema: str) -> Iterator[tuple[dict, DataFrame]]:
        for segment in self.segments:
            rows = self.snapshot.load(segment, schema, below).select(*[c.split()[0] for c in schema.split(", ")])
            yield segment, rows.withColumn("segment", F.lit(segment["number"]).cast("bigint"))

    def _all(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.sparkSession.createDataFrame([], f"{schema}, segment bigint")

    @property
    def gone(self) -> DataFrame | None:
        """(segment, id, length, block) of documents that a segment holds no longer."""
        return reduce(DataFrame.union, [self.snapshot.load(p, _GONE) for p in self.notes]) if self.notes else None

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self.gone
        if gone is None:
            return rows
        few = sum(p["docs"] for p in self.notes) <= HELD
        return rows.join(gone.select("segment", "id").hint("broadcast" if few else "shuffle_hash"), ["segment", "id"], "left_anti")

    def _of(self, below: str, schema: str, words: list[str] | None, blocks: dict[int, list[int]] | None = None) -> DataFrame:
        """Rows of some tokens, of each segment their buckets alone; with ``blocks``, rows of those blocks of each segment alone."""
        frames = []
        for segment, rows in self._each(below, schema):
            if words is None:
                rows = rows.where("token is not null")
            else:
                place = lambda w, n=segment["buckets"]: F.col("bucket") == _bucket(F.lit(w), n)  # noqa: E731  a constant, so folders are pruned
                rows = rows.where(reduce(Column.__or__, map(place, words))).where(F.col("token").isin(*words))
            if blocks is not None:
                if not blocks.get(segment["number"]):
                    continue
                rows = rows.where(F.col("block").isin(*blocks[segment["number"]]))
            frames.append(rows)
        return self._all(frames, schema)

    def words(self, words: list[str] | None, blocks: dict[int, list[int]] | None = None) -> DataFrame:
        """(segment, block, token, id, n, length, places) of documents that are there."""
        return self._live(self._of("/kind=words", _WORDS, words, blocks))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """(id, field, pos, token) of rows of words (segment, id, token, places)."""
        lists: dict[tuple[str, ...], list[int]] = {}
        for p in self.segments:
            lists.setdefault(tuple(p["fields"]), []).append(p["number"])
        name = lambda fields: F.get(F.array(*[F.lit(f) for f in fields]).cast("array<string>"), F.shiftright("_p", 32).cast("int"))
        field = F.lit(None).cast("string")
        for fields, numbers in lists.items():
            field = name(fields) if len(lists) == 1 else F.when(F.col("segment").isin(*numbers), name(fields)).otherwise(field)
        each = rows.select("segment", "id", "token", F.explode("places").alias("_p"))
        return each.select("id", field.alias("field"), F.col("_p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), "token")

    def renumbered(self) -> tuple[DataFrame, list[str]]:
        """(id, token, n, length, places) of all documents that are there, with the fields of all segments, by whose order places number them."""
        every = sorted({f for p in self.segments for f in p["fields"]})
        rows = self.words(None)
        for p in self.segments:
            if p["fields"] != every:
                new = F.array(*[F.lit(every.index(f)).cast("bigint") for f in p["fields"]])
                moved = F.transform("places", lambda x: F.shiftleft(F.get(new, F.shiftright(x, 32).cast("int")), 32) + x.bitwiseAND(F.lit((1 << 32) - 1)))  # noqa: B023  called at once
                rows = rows.withColumn("places", F.when(F.col("segment") == p["number"], moved).otherwise(F.col("places")))
        return rows.select("id", "token", "n", "length", "places"), every

    @property
    def docs(self) -> DataFrame:
        """(segment, block, id, length) of documents that are there."""
        return self._live(self._all([_documents(rows).select("id", "length", "block", "segment") for _, rows in self._each("/kind=words", _WORDS)], _DOCS))

    @property
    def lengths(self) -> DataFrame:
        return self.docs.select("id", "length")

    @property
    def posting(self) -> DataFrame:
        return self._placed(self.words(None))

    def of_tokens(self, words: list[str]) -> DataFrame:
        return self._placed(self.words(words))

    def size(self) -> tuple[int, float]:
        """Number of documents and their mean length, from what was counted when they were written."""
        docs = sum(p["docs"] for p in self.segments) - sum(p["docs"] for p in self.notes)
        words = sum(p["words"] for p in self.segments) - sum(p["words"] for p in self.notes)
        return docs, words / docs if docs else 0.0

    def totals(self) -> DataFrame:
        docs, mean = self.size()
        return self.sparkSession.range(1).select(F.lit(float(docs)).alias("docs"), F.lit(float(mean)).alias("mean"))

    def hits(self, found: list[list[str]]) -> DataFrame:
        out = []
        for i, phrase in enumerate(found):
            rows = self.words(phrase)
            if len(phrase) > 1:
                one = occurrences(self._placed(rows), phrase)
                rows = one.join(rows.where(F.col("token") == phrase[0]).select("id", "length"), "id")
            out.append(rows.select("id", F.lit(i).alias("i"), "n", "length"))
        return reduce(DataFrame.union, out)

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """In how many documents each token is: the sums of what is stored for its blocks, less the documents that are gone, for which only the blocks that held them are read."""
        rows = self._of("/kind=bounds", _BOUNDS, words).groupBy("token").agg(F.sum("id").alias("n")).collect()  # a row for each word of the query
        count = {r["token"]: r["n"] for r in rows}
        gone = self.gone
        if gone is not None and count:
            touched = gone.select("segment", "block").distinct().limit(NAMED + 1).collect()
            blocks: dict[int, list[int]] = {}
            for r in touched:
                blocks.setdefault(r["segment"], []).append(r["block"])
            held = self._of("/kind=words", _WORDS, words, blocks if len(touched) <= NAMED else None).join(gone.select("segment", "id"), ["segment", "id"], "left_semi")
            for r in held.groupBy("token").agg(F.count("*").alias("n")).collect():
                count[r["token"]] -= r["n"]
        return {w: count.get(w, 0) for w in words}

    def bounds(self, words: list[str], idf: dict[str, float], mean: float) -> DataFrame:
        """(segment, block, bound) of blocks that hold all tokens: no document there scores more."""
        most = reduce(lambda x, w: F.when(F.col("token") == w, F.lit(idf[w])).otherwise(x), words, F.lit(0.0)) * part(F.col("most"), F.col("least"), mean)
        each = self._of("/kind=bounds", _BOUNDS, words).groupBy("segment", "block", "token").agg(F.max("n").alias("most"), F.min("length").alias("least"))  # a block's rows may lie in several files
        rows = each.groupBy("segment", "block").agg(F.sum(most).alias("bound"), F.count("*").alias("m"))
        return rows.where(F.col("m") == len(words)).select("segment", "block", (F.col("bound") * (1 + 1e-9) + 10.0**-PLACES).alias("bound"))  # scores are rounded

    def best(self, words: list[str], k: int, within: DataFrame | None = None) -> list[tuple[float, int]] | None:
        """(score, id) of the k documents of the highest BM25 (to PLACES decimals) that hold all tokens, ties to the smaller id; of those ``within`` (id), where given.

        Blocks are read in waves, those of the highest bounds first and each wave twice the one before, until the next
        bound is under the k-th score: the rest cannot hold a better document. None if there is a phrase among the
        words, whose number of documents no block knows, or if k is beyond MOST: then all hits are scored.
        """
        found = phrases(self.sparkSession, words)
        if any(len(p) > 1 for p in found) or k > MOST:
            return None
        often: dict[str, int] = {}
        for p in found:
            often[p[0]] = often.get(p[0], 0) + 1
        names = list(often)
        docs, mean = self.size()
        count = self.frequencies(names) if names else {}
        if not names or k <= 0 or not all(count.values()):
            return []
        idf = {w: often[w] * max(log((docs - n + 0.5) / (n + 0.5)), LEAST_IDF) for w, n in count.items()}
        weight = reduce(lambda x, w: F.when(F.col("token") == w, F.lit(idf[w])).otherwise(x), names, F.lit(0.0))
        blocks = self.bounds(names, idf, mean).persist()  # a row for each block of documents
        try:
            top: list[tuple[float, int]] = []  # a heap of (score, -id)
            wave, taken = max(4, 2 * k // BLOCK), 0
            while True:
                least = top[0][0] if len(top) == k else float("-inf")
                next_ = blocks.orderBy(F.desc("bound"), "segment", "block").offset(taken).limit(wave).collect()
                named = [r for r in next_ if r["bound"] >= least]
                if not named:
                    return sorted(((s, -i) for s, i in top), key=lambda x: (-x[0], x[1]))
                if wave >= NAMED:  # all that are left, in one pass
                    last, rows = named[0], self.words(names)
                    left = blocks.where(F.col("bound") >= least).where((F.col("bound") < last["bound"]) | ((F.col("bound") == last["bound"]) & (F.struct("segment", "block") >= F.struct(F.lit(last["segment"]).cast("bigint"), F.lit(last["block"]).cast("bigint")))))
                    rows = rows.join(left.select("segment", "block"), ["segment", "block"], "left_semi")
                else:
                    at: dict[int, list[int]] = {}
                    for r in named:
                        at.setdefault(r["segment"], []).append(r["block"])
                    rows = self.words(names, at)
                scored = rows.groupBy("id").agg(F.round(F.sum(weight * part(F.col("n"), F.col("length"), mean)), PLACES).alias("s"), F.count("*").alias("m")).where(F.col("m") == len(names)).where(F.col("s") >= least)
                if within is not None:
                    scored = scored.join(within.select("id"), "id", "left_semi")
                for r in scored.orderBy(F.desc("s"), "id").limit(k).collect():
                    heapq.heappush(top, (r["s"], -r["id"]))
                    if len(top) > k:
                        heapq.heappop(top)
                if wave >= NAMED or len(next_) < wave or len(named) < len(next_):
                    return sorted(((s, -i) for s, i in top), key=lambda x: (-x[0], x[1]))
                taken, wave = taken + wave, 2 * wave
        finally:
            blocks.unpersist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents (id, a list of words for each field) the runs of equal words, as ``sorted_words`` gives them; about WORDS words at once."""
    for batch in batches:
        sizes = np.stack([pc.list_value_length(c).to_numpy() for c in batch.columns[1:]]) if batch.num_columns > 1 else np.zeros((1, batch.num_rows), int)
        length = sizes.sum(axis=0).astype(np.int64)
        part = np.cumsum(length) // WORDS
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            some, n = batch.slice(start, end - start), length[start:end]
            none = np.flatnonzero(n == 0)
            words = pa.concat_arrays([c.flatten() for c in some.columns[1:]] or [pa.array([], pa.string())]).dictionary_encode()
            each = [x[start:end].astype(np.int64) for x in sizes]
            doc = np.concatenate([np.repeat(np.arange(end - start), x) for x in each])
            at = np.concatenate([(f << 32) + np.arange(x.sum()) - np.repeat(np.cumsum(x) - x, x) for f, x in enumerate(each)])
            by = pc.sort_indices(words.dictionary).to_numpy()
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            key = doc * max(1, len(by)) + rank[words.indices.to_numpy()]
            order = np.argsort(key, kind="stable")  # places stay by field
            key = key[order]
            new = np.flatnonzero(np.diff(key, prepend=-1))
            owner = doc[order[new]]
            token = pa.concat_arrays([words.dictionary.take(words.indices.take(pa.array(order[new]))), pa.nulls(len(none), words.dictionary.type)])
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(key)).astype(np.int32)), pa.array(at[order]))
            places = pa.concat_arrays([places, pa.nulls(len(none), places.type)])
            rows = np.concatenate([owner, none])
            first = np.diff(owner, prepend=-1) != 0
            columns = [some.column(0).take(pa.array(rows)), pa.array(n[rows].astype(float)), pa.array(np.concatenate([first, np.ones(len(none), bool)])), token, places]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "length", "first", "token", "places"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words (token, block, n, length, bucket) as they lie in their files, the documents, most occurrences and least length of each run of a token's block; one cut by a batch or a file gives a row for each piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        token, block = batch.column(0), batch.column(1).to_numpy()
        new = pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
        first = np.concatenate([[0], np.flatnonzero(new) + 1])
        docs = np.diff(np.concatenate([first, [batch.num_rows]]))
        most, least = np.maximum.reduceat(batch.column(2).to_numpy(), first), np.minimum.reduceat(batch.column(3).to_numpy(), first)
        yield pa.RecordBatch.from_arrays([token.take(pa.array(first)), *map(pa.array, (block[first], docs, most, least)), batch.column(4).take(pa.array(first))], names=["token", "block", "id", "n", "length", "bucket"])


def _documents(words: DataFrame) -> DataFrame:
    """The rows of documents among those of words."""
    return words.where("bucket = 0 and token is null")


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(buckets)).cast("int")


def _inverted(batches: Iterator[pa.RecordBatch], buckets: int, block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Of documents (id, the words of each field with a space between, bytes) the rows of a segment (_ROWS), in order of kind, bucket, token and block; about ``most`` words at once.

    Documents in order of length are ``block`` to a block; a block is this task's alone.
    """
    task, blocks = TaskContext.get().partitionId(), 0
    held: list[tuple[pa.RecordBatch, np.ndarray]] = []
    many = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.columns[1:-1]
        sizes = np.stack([np.where(pc.binary_length(c).to_numpy() > 0, pc.count_substring(c, " ").to_numpy() + 1, 0) for c in texts]) if texts else np.zeros((1, batch.num_rows), int)
        sizes = sizes.astype(np.int64)
        part = (many + np.cumsum(sizes.sum(axis=0))) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and part[start]:  # full, or full with these
                yield from _sorted(held, buckets, block, task, blocks)
                blocks += sum(b.num_rows for b, _ in held)
                held, many = [], 0
            held.append((batch.slice(start, end - start), sizes[:, start:end]))
            many += int(sizes[:, start:end].sum())
    if held:
        yield from _sorted(held, buckets, block, task, blocks)


def _sorted(held: list[tuple[pa.RecordBatch, np.ndarray]], buckets: int, block: int, task: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """The rows of a segment of some documents whose numbers of words by field are given; their blocks are numbered from ``blocks`` on."""
    sizes = np.concatenate([x for _, x in held], axis=1)
    by_length = np.argsort(sizes.sum(axis=0), kind="stable")
    docs, sizes = pa.Table.from_batches([b for b, _ in held]).take(pa.array(by_length)).combine_chunks(), sizes[:, by_length]
    length, ids = sizes.sum(axis=0), docs.column(0).combine_chunks()
    number = np.arange(len(length)) // block  # of each document's block
    name = (task << 32) + blocks + number

    words, doc, at = [], [], []
    for f, column in enumerate(docs.columns[1:-1]):
        some = np.flatnonzero(sizes[f])
        n = sizes[f][some]
        words += pc.list_flatten(pc.split_pattern(column.take(pa.array(some)), " ")).chunks
        doc.append(np.repeat(some, n))
        at.append((f << 32) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    codes = pa.concat_arrays(words or [pa.array([], pa.string())]).dictionary_encode()
    doc, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, at))
    bucket = np.array([zlib.crc32(w.encode()) % buckets for w in codes.dictionary.to_pylist()], np.int32)
    rank = np.empty(len(bucket), np.int64)
    rank[pc.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(bucket))
    by = np.lexsort((rank, bucket))  # the different words by bucket and token
    rank[by] = np.arange(len(by))
    key = rank[codes.indices.to_numpy()] * len(length) + doc
    order = np.argsort(key, kind="stable")  # places stay by field
    key, at = key[order], at[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    word, doc, n = key[new] // len(length), key[new] % len(length), np.diff(np.append(new, len(key)))
    start = np.flatnonzero(np.diff(word * (int(number[-1]) + 1) + number[doc], prepend=-1))
    token, bucket = codes.dictionary.take(pa.array(by)), bucket[by]

    schema = {"kind": pa.string(), "bucket": pa.int32(), "token": pa.string(), "block": pa.int64(), "id": pa.int64(), "n": pa.int64(), "length": pa.float64(), "places": pa.list_(pa.int64())}

    def rows(kind: str, many: int, **given) -> pa.RecordBatch:
        given["kind"] = pa.repeat(pa.scalar(kind), many)
        return pa.RecordBatch.from_arrays([pa.array(given[c], t) if isinstance(given.get(c), np.ndarray) else given.get(c, pa.nulls(many, t)) for c, t in schema.items()], names=list(schema))

    if len(start):
        w, d = word[start], doc[start]
        counts = np.diff(np.append(start, len(word)))
        yield rows("bounds", len(start), bucket=bucket[w], token=token.take(pa.array(w)), block=name[d], id=counts, n=np.maximum.reduceat(n, start), length=np.minimum.reduceat(length[doc], start).astype(float))
    yield rows("words", len(length), bucket=np.zeros(len(length), np.int32), block=name, id=ids, length=length.astype(float))
    for a in range(0, len(word), ROWS):
        w, d, ends = word[a : a + ROWS], doc[a : a + ROWS], np.append(new, len(key))[a : a + ROWS + 1]
        places = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(at[ends[0] : ends[-1]]))
        yield rows("words", len(w), bucket=bucket[w], token=token.take(pa.array(w)), block=name[d], id=ids.take(pa.array(d)), n=n[a : a + ROWS], length=length[d].astype(float), places=places)


def _step(length: Column) -> Column:
    """Documents of one step may share a block."""
    return F.floor(F.log2(length + 1) * STEPS).cast("int")


def _numbered(change: Change) -> int:
    return 1 + max((p["number"] for p in change.parts(NAME) if p["kind"] == "segment"), default=0)


def counted(held: DataFrame) -> DataFrame:
    """(id, token, n, length, places) of ``sorted_words``: the words of each document, with how often and where they are and how long it is.

    A document's words are counted within its row; documents of one id, should there be any, are put together.
    """
    rows = held.where("token is not null").select("id", "token", F.size("places").cast("bigint").alias("n"), "length", "places")
    if not held.where("first").groupBy("id").count().where("count > 1").limit(1).count():
        return rows
    return rows.groupBy("id", "token").agg(F.sum("n").alias("n"), F.max("length").alias("length"), F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


def _written(change: Change, folder: str, name: str, buckets: int, fields: list[str]) -> dict:
    """What a version says of a segment that lies in a folder."""
    n, total = _documents(change.spark.read.schema(_WORDS).parquet(f"{folder}/kind=words")).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0.0))).first()
    return {"folder": name, "kind": "segment", "number": _numbered(change), "docs": n, "words": total, "buckets": buckets, "fields": fields}


def _make(change: Change, texts: DataFrame, most_buckets: int, fields: list[str]) -> dict | None:
    """A segment of documents, each of an id of its own, as ``texts`` gives them; None if there are none.

    Texts go to tasks by their ids, and to so many that each sorts about PER_TASK words.
    """
    n, total = texts.agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    if not n:
        return None
    name, folder = change.folder(NAME)
    buckets, block, most = max(1, min(most_buckets, n // PER_BUCKET)), BLOCK, 2 * PER_TASK
    tasks = max(1, -(-total // (BYTES * PER_TASK)))
    rows = texts.repartition(tasks, "id").mapInArrow(lambda batches: _inverted(batches, buckets, block, most), _ROWS)
    rows.sortWithinPartitions("kind", "bucket", "token", "block").write.partitionBy("kind", "bucket").option("parquet.page.row.count.limit", PAGE).parquet(folder)
    if not total:  # no words, so no folder of their bounds
        change.spark.createDataFrame([], _BOUNDS).write.parquet(f"{folder}/kind=bounds")
    return _written(change, folder, name, buckets, fields)


def _write(change: Change, words: DataFrame, docs: DataFrame, fields: list[str], most_buckets: int = BUCKETS) -> dict | None:
    """A segment of words (id, token, n, length, places) of documents (id, length); None if there are no documents.

    Words go to tasks by bucket and hash of the block, without a look at them before, and of so many that each task sorts about PER_TASK in memory.
    """
    name, folder = change.folder(NAME)
    spark = change.spark
    found = docs.groupBy(_step(F.col("length")).alias("step")).agg(F.count("*").alias("n"), F.sum("length").alias("words")).collect()  # some hundred at most
    if not found:
        return None
    steps, n, total = {r["step"]: r["n"] for r in found}, sum(r["n"] for r in found), sum(r["words"] for r in found)
    many = F.create_map(*[F.lit(x).cast("int") for s, n in steps.items() for x in (s, -(-n // BLOCK))])
    block = (F.shiftleft(_step(F.col("length")).cast("bigint"), 32) + F.pmod(F.xxhash64("id"), many[_step(F.col("length"))])).alias("block")
    buckets = max(1, min(most_buckets, n // PER_BUCKET))
    bucket = F.coalesce(_bucket(F.col("token"), buckets), F.lit(0))
    each = max(1, int(-(-total // (buckets * PER_TASK))))  # tasks of a bucket, by the hash of the block, so that no word is a task's alone and a task's words do not grow
    written = lambda df: df.write.partitionBy("bucket").option("parquet.page.row.count.limit", PAGE)
    by = ("bucket", "token", "block", "id")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("token", "string"), ("places", _PLACES))]
    rows = words.select("token", block, "id", "length", "places").unionByName(docs.select("id", "length", block, *none))
    sent = rows.repartitionById(buckets * each, bucket * each + F.pmod(F.xxhash64("block"), F.lit(each)).cast("int"))
    dealt = sent.select("token", "block", "id", F.when(F.col("places").isNotNull(), F.size("places")).cast("bigint").alias("n"), "length", "places", bucket.alias("bucket")).sortWithinPartitions(*by)
    written(dealt).parquet(f"{folder}/kind=words")
    held = spark.read.schema(_WORDS).parquet(f"{folder}/kind=words").where("token is not null").select("token", "block", "n", "length", "bucket")
    written(held.mapInArrow(_bounds, _BOUNDS).sortWithinPartitions("bucket", "token", "block")).parquet(f"{folder}/kind=bounds")
    return _written(change, folder, name, buckets, fields)


def add_segment(change: Change, index: TextIndex, buckets: int = BUCKETS) -> None:
    """Add the documents of an index made anew, none of which the stored one holds, as a segment."""
    fields, texts = sorted(index.fields), settled(index.texts())  # read for their size and ids, and then whole
    if texts.groupBy("id").count().where("count > 1").limit(1).count():  # documents of one id, which are put together
        held = settled(index.sorted_words())
        segment = _write(change, counted(held), held.where("first").select("id", "length"), fields, buckets)
    else:
        segment = _make(change, texts, buckets, fields)
    if segment:
        change.name(NAME, [*change.parts(NAME), segment])


def forget(change: Change, ids: DataFrame) -> None:
    """Note that documents (id) are gone; ids that the index does not hold are ignored."""
    index = Segments(change)
    change.parts(NAME)
    if not index.segments:
        return
    name, folder = change.folder(NAME)
    index.docs.join(ids.select("id").distinct(), "id", "left_semi").select("segment", "id", "length", "block").repartition("id").write.parquet(folder)
    docs, words = change.spark.read.schema(_GONE).parquet(folder).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0.0))).first()
    if docs:
        change.name(NAME, [*change.parts(NAME), {"folder": name, "kind": "gone", "docs": docs, "words": words}])


def merge(change: Change, at_once: int = MERGE) -> int:
    """Merge segments of a like size, ``at_once`` or more of them, without the documents that are gone; how many segments went into others."""
    went = 0
    while True:
        index = Segments(change)
        sizes: dict[int, list[dict]] = {}
        for p in index.segments:
            sizes.setdefault(int(log(max(p["docs"], 1), at_once)), []).append(p)
        full = next((ps for _, ps in sorted(sizes.items()) if len(ps) >= at_once), None)
        if full is None:
            return went
        some = Segments(Snapshot(change.catalog, 0, {NAME: [*full, *index.notes]}))
        words, fields = some.renumbered()
        segment = _write(change, words, some.docs.select("id", "length"), fields)
        numbers = {p["number"] for p in full}
        notes = []
        if index.notes:
            name, folder = change.folder(NAME)
            index.gone.where(~F.col("segment").isin(*numbers)).repartition("id").write.parquet(folder)
            docs, words = change.spark.read.schema(_GONE).parquet(folder).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0.0))).first()
            notes = [{"folder": name, "kind": "gone", "docs": docs, "words": words}] if docs else []
        change.name(NAME, [p for p in index.segments if p["number"] not in numbers] + ([segment] if segment else []) + notes)
        went += len(full)


def reindex(change: Change, docs: DataFrame, ids: DataFrame, at_once: int = MERGE) -> None:
    """Make the index hold, of the documents ``ids`` (id), what ``docs`` (id and fields) says, and of the others what it held."""
    forget(change, ids)
    add_segment(change, TextIndex(docs))
    merge(change, at_once)


__all__ = ["FIELDS", "MARKED", "PLAIN", "Segments", "TextIndex", "add_segment", "forget", "merge", "occurrences", "part", "phrases", "postings", "reindex", "tokens"]
