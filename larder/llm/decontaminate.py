"""Benchmark decontamination by template canonicalisation.

Words in lower case are literals; numbers, names (capitalised within a sentence) and units (after a number) become
typed placeholders, whose values are slots. Every window of ``WINDOW`` canonical words with enough literals is
hashed, and every window with a placeholder once more as it was written, so that text made of numbers and names is
met where it is verbatim. A bitmap of fixed size over the benchmark's windows thins out the documents' windows where they are made; the
rest meet the benchmark in a hash join. Matches on one alignment of a document and an item must cover enough of the
item and map each slot value of the item to one value of the document and back: the same values are a verbatim
leak, others a re-parameterised one.

Items of fewer than WINDOW words are sought as one window of their own length; those of fewer than ``LEAST_ITEM``
words only as they are written. In scripts without spaces every character is a word. Items without a word, or null,
are not sought. Repeated items count as the smallest item_id. Null and empty texts hold nothing. Rows
that share a doc_id count as one document, in ``leaks`` also those without one; ``cleaned`` judges those one by one.
Other columns are not read, whatever their names. Whole texts are searched; there is no cap on matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, in_batches, lower, mixed, packed, run_hashes, table, unused, without

#: Words of a window, words of the shortest item sought in other values, words that a leak must cover (or the share of a shorter item), the least share of consistent slots, and bits of the bitmap.
WINDOW, LEAST_ITEM, COVER, SHARE, CONSISTENT, MAP_BITS = 8, 4, 13, 0.8, 0.8, 24
#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs hours minutes seconds days weeks months years percent usd eur gbp dollars euros cents mph kmh kph kb mb gb tb hz khz mhz ghz w kw v c f k meters metres miles feet inches pounds grams kilograms liters litres".split()
_CLASS = np.zeros(256, np.int8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
#: Code points of scripts without spaces (Thai to Tibetan, Burmese, Khmer, kana and ideographs), and of full-width punctuation and space.
UNSPACED = ((0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
PUNCTUATION = ((0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0xFE30, 0xFE4F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_WORDS = "doc_id long, w int, pos int, h long, written boolean, slots array<long>"


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(run_hashes(data, np.array([0]), np.array([len(data)]))[0][0])


_UNIT_HASHES = np.unique(np.array([_hash(x) for x in UNITS], np.uint64))
NUMBER, NAME, UNIT = (np.uint64(_hash(x)) for x in ("<number>", "<name>", "<unit>"))


def _unspaced(part: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> None:
    """Make every character of unspaced scripts a word in ``kind`` and ``edge``, and full-width punctuation no word."""
    for lead, bits, size in ((0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
        at = np.flatnonzero((part & np.uint8(0xFF ^ bits)) == lead)
        at = at[at + size <= len(part)]
        if not at.size:
            continue
        code = (part[at] & np.uint8(bits)).astype(np.int64)
        for k in range(1, size):
            code = (code << 6) | (part[at + k] & np.uint8(0x3F))
        within = lambda ranges, code=code: np.any([(code >= a) & (code <= b) for a, b in ranges], axis=0)
        marks = within(PUNCTUATION)
        for k in range(size):
            kind[at[marks] + k] = 0
        alone = at[within(UNSPACED) | marks]
        edge[alone] = edge[alone + size] = True


def canonical(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a chunk: canonical hash, hash of what was written, row."""
    kind = _CLASS[part]
    inner = np.zeros(len(part), bool)  # points and commas within a number
    if len(part) > 2:
        inner[1:-1] = ((part[1:-1] == 46) | (part[1:-1] == 44)) & (kind[:-2] == 2) & (kind[2:] == 2)
        kind = np.where(inner, 2, kind)
    edge = np.ones(len(part) + 1, bool)
    edge[1:-1] = False
    _unspaced(part, kind, edge)
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[bounds] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    word = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = lower(part)
    written = run_hashes(low, starts, ends)[0]
    row = np.searchsorted(bounds, starts, "right") - 1
    number = kind[starts] == 2
    follows = np.zeros(len(starts), bool)
    follows[1:] = row[1:] == row[:-1]
    gap = np.concatenate([[0], starts[1:] - ends[:-1]])
    spaced = follows & (gap == 1) & (part[starts - 1] == 32)
    upper = low != part
    ups = np.add.reduceat(upper, starts, dtype=np.int64)
    head = upper[starts] | ((part[starts] == 0xC3) & upper[np.minimum(starts + 1, len(part) - 1)])
    name = ~number & spaced & head & (ups == 1) & (ends - starts > 1)
    after = np.concatenate([[False], number[:-1]]) & (spaced | (follows & (gap == 0)))
    unit = ~number & after & np.isin(written, _UNIT_HASHES)
    return np.select([number, unit, name], [NUMBER, UNIT, NAME], written), written, row


def windows(canon: np.ndarray, written: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word, and whether the words are as written, of every window of ``size`` words in one row.

    Canonical windows are at least half literals; a window with placeholders is hashed as written, too. Of a window of
    fewer than LEAST_ITEM words only the first as written in a row comes out.
    """
    n = len(canon) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def hashed(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[at + k]
        return mixed(h + np.uint64(size))

    slot = np.concatenate([[0], np.cumsum((canon == NUMBER) | (canon == NAME) | (canon == UNIT))])
    slots, inside = slot[size:] - slot[:n], row[size - 1 :] == row[:n]
    if size < LEAST_ITEM:
        at = np.flatnonzero(inside)
        h = hashed(written, at)
        first = np.sort(np.unique(np.stack([row[at].astype(np.uint64), h]), axis=1, return_index=True)[1])
        return h[first], at[first], np.ones(len(first), bool)
    at, as_written = np.flatnonzero(inside & (2 * slots <= size)), np.flatnonzero(inside & (slots > 0))
    return np.concatenate([hashed(canon, at), hashed(written, as_written)]), np.concatenate([at, as_written]), np.repeat([False, True], [len(at), len(as_written)])


def _rows(ids: pa.Array, text: pa.Array, sizes: list[int], keep, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Windows as rows of _WORDS; ``keep`` thins out hashes; whole: a row of fewer than WINDOW words is one window."""
    data, offsets = packed(text)
    ids = ids.cast(pa.int64())
    for i, _, part, bounds in chunks(data, offsets):
        canon, written, row = canonical(part, bounds)
        first = np.searchsorted(row, np.arange(len(bounds)))
        length = np.diff(first)
        slot = (canon == NUMBER) | (canon == NAME) | (canon == UNIT)
        for size in sizes:
            h, at, raw = windows(canon, written, row, size)
            if whole and size < WINDOW:
                only = length[row[at]] == size
                h, at, raw = h[only], at[only], raw[only]
            hit = keep(h)
            h, at, raw = h[hit], at[hit], raw[hit]
            if len(at):
                slots = [written[a : a + size][slot[a : a + size]].view(np.int64).tolist() for a in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i + row[at])), pa.array(np.full(len(at), size, np.int32)), pa.array((at - first[row[at]]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(raw), pa.array(slots, pa.list_(pa.int64()))],
                    names=["doc_id", "w", "pos", "h", "written", "slots"],
                )


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words and a hash of the words of every item, repeated ones once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = packed(batch.column(1))
            canon, written, row = canonical(data, offsets)
            first = np.searchsorted(row, np.arange(len(offsets)))
            sums = [np.bitwise_xor.reduce(mixed(written[a:b] + mixed(np.arange(b - a, dtype=np.uint64) + canon[a:b]))) if b > a else 0 for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(first).astype(np.int32)), pa.array(np.array(sums, np.uint64).view(np.int64))], names=["item_id", "n_words", "sum"])

    found = benchmark.where("item_id is not null").select("item_id", "text").transform(in_batches, work, "item_id long, n_words int, sum long")
    return found.groupBy("sum", "n_words").agg(F.min("item_id").alias("item_id")).where("n_words > 0").select("item_id", "n_words")


def _covered(at: str, size: str) -> Column:
    """Words within windows of ``size`` words that begin at sorted places."""
    steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.size(at) - 1), lambda x, y: F.least(x - y, F.col(size)))
    return F.aggregate(steps, F.col(size), lambda x, y: x + y)


def promising(met: DataFrame, bench: DataFrame) -> DataFrame:
    """The windows of documents that can be part of a leak, before any meets an item.

    Windows meet the distinct windows of the benchmark, one row each however many items share one. The windows of a
    document, and its different ones as often as an item can have them, must cover as many words as some item with
    that window asks for. So a prompt that many items begin with does not meet them all in every text that holds it.
    """
    each = bench.groupBy("item_id", "h", "w").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    kinds = each.groupBy("h", "w").agg(F.max("n").alias("often"), F.min("need").alias("need"))
    met = cut(met.join(kinds, ["h", "w"]))
    kept = met.groupBy("doc_id", "w", "h").agg(F.least(F.count("*"), F.first("often")).alias("n"), F.collect_set("pos").alias("at"))
    held = kept.groupBy("doc_id", "w").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), (F.sum("n") * F.col("w")).alias("words")).select(F.col("doc_id").alias("_doc"), F.col("w").alias("_w"), F.least(_covered("at", "w"), "words").alias("most"))
    return met.join(held, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("w") == F.col("_w"))).where("most >= need").drop("_doc", "_w", "most", "often", "need")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, kind (verbatim, reparameterised), covered and item words, slots, consistency."""
    sc = docs.sparkSession.sparkContext
    known = cut(items(benchmark))
    sizes = sorted(r[0] for r in known.select(F.least("n_words", F.lit(WINDOW)).alias("w")).distinct().collect())  # numbers up to WINDOW
    every = lambda h: np.ones(len(h), bool)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _rows(batch.column(0), batch.column(1), sizes, every, whole=True)

    bench = benchmark.select("item_id", "text").transform(in_batches, of_items, _WORDS).withColumnsRenamed({"doc_id": "item_id", "slots": "item_slots", "pos": "item_pos", "written": "item_written"})
    bench = cut(bench.join(known, "item_id").dropDuplicates(["item_id", "w", "item_pos", "item_written"]))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            packed_bits = np.unique(at >> 3)
            yield pa.RecordBatch.from_arrays([pa.array(packed_bits), pa.array([int(np.bitwise_or.reduce(1 << (at[at >> 3 == b] & 7))) for b in packed_bits.tolist()], pa.int64())], names=["byte", "value"])

    bitmap = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    marked = bench.select("h").transform(in_batches, bits, "byte long, value long").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()  # at most 2^(MAP_BITS - 3) bytes
    bitmap[marked["byte"].to_numpy()] = marked["value"].to_numpy().astype(np.uint8)
    shared = sc.broadcast(bitmap)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def maybe(h: np.ndarray) -> np.ndarray:
            at = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            return (shared.value[at >> 3] >> (at & 7)) & 1 > 0

        for batch in batches:
            yield from _rows(batch.column(0), batch.column(1), sizes, maybe)

    bench = bench.withColumn("need", F.least(F.lit(COVER), F.ceil(SHARE * F.col("n_words"))).cast("int"))
    met = docs.select("doc_id", "text").transform(in_batches, of_docs, _WORDS)
    found = promising(met, bench).join(bench.drop("need"), ["h", "w"])
    values = F.when(F.col("written") | F.col("item_written"), F.col("item_slots")).otherwise(F.col("slots"))  # as written: those of the item, also where only one side has a placeholder
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", values.alias("slots")))))
    lines = found.groupBy("doc_id", "item_id", "n_words", "w", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.array_sort(F.collect_set("item_pos")).alias("at"), pairs.alias("pairs"))
    one = lambda c: F.size(F.array_distinct(F.col(f"pairs.{c}")))
    lines = lines.select("doc_id", "item_id", "n_words", _covered("at", "w").alias("covered"), F.size("pairs").alias("slots"), F.when(F.size("pairs") == 0, 1.0).otherwise(F.least(one("item_slots"), one("slots")) / F.size("pairs")).alias("consistency"), F.exists("pairs", lambda p: p["item_slots"] != p["slots"]).alias("changed"))
    lines = lines.where((F.col("covered") >= F.least(F.lit(COVER), F.ceil(SHARE * F.col("n_words")))) & (F.col("consistency") >= CONSISTENT))
    best = lines.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("covered", "n_words", "slots", "consistency", "changed"), F.struct("covered", "consistency", ~F.col("changed"))).alias("x"))
    return best.select("doc_id", "item_id", F.when(F.col("x.changed"), "reparameterised").otherwise("verbatim").alias("kind"), F.col("x.covered").cast("int").alias("covered"), F.col("x.n_words").alias("item_words"), F.col("x.slots").alias("slots"), F.col("x.consistency").alias("consistency"))


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; a row without doc_id is known by the hash of its text, and stays if it has none."""
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.when(F.col("text").isNotNull(), F.xxhash64("text"))))
    found = leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark)
    return without(keyed, found.select(F.col("doc_id").alias(key)), key).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
