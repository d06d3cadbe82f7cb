"""Spelling variants grouped by permuterm rotations.

A word is marked with a terminator at its end and rotated to every place. Sorted, rotations that agree but for their
last letter stand together: cut off that letter, and a prefix ``tail $ head`` is shared by all words that differ from
each other in the one letter between head and tail. A word without such a letter stands in the same range whole, as the
rotation ``tail $ head`` itself, so an inserted or deleted letter is met there too. A prefix therefore holds at most
one whole rotation and one word for each letter of the alphabet, whatever the number of words. A run of equal letters
gives the same shorter word whichever of them is skipped; only the first of a run counts, so no pair is met twice.

A scan of a range gives each word of it the number of the others and the best of them (the first but itself, so two
are enough): pairs are never written out. Words are then summed up, a row for each range that holds a neighbour.

Rotations of words beyond ``LONG`` code points would take space in the square of their length; their prefixes are keyed
by polynomial hashes modulo 2^127 - 1, of which every rotation's follows from two running ones (that two of n prefixes
collide has a chance of about n^2 / 2^128; shorter words are compared as they are).

Null texts have no words. A null doc_id is written as nothing before the colon. Texts are taken whole; repeated rows
count as often as they stand. Columns other than doc_id and text are not read. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_batches, removed, shared_folder, table, written

#: What a word is, the letters of one word in so many are mistyped, and the least length and number of a word.
RUN, TYPO, LEAST_LENGTH, LEAST_COUNT = "([A-Za-zÀ-ÿ]+)", 97, 5, 3
#: How many times more frequent a word's form is at least.
TIMES = 2
#: Code points of a prefix up to which it is its own key.
LONG = 64
END = "$"
_PRIME, _BASE = (1 << 127) - 1, 0x5BD1E995_9E3779B9_85EBCA6B
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ENTRY = "id string, n long, key string, letter string, first boolean"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): runs of letters, some of them mistyped by the rule, that are long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 1)).alias("run")).select("doc_id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(h % typo == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _short(rows: DataFrame) -> DataFrame:
    """Entries of (word, n) whose prefixes are at most LONG code points; a word is its own id."""
    size = F.char_length("word")
    # place i of 0 .. size - 1: the letter is skipped; size + i: the whole rotation that begins at i
    each = rows.select("word", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), 2 * size)).alias("place")).where((F.col("size") < LONG) | (F.col("place") < F.col("size")))
    skip = F.col("place") < F.col("size")
    at = F.when(skip, F.col("place")).otherwise(F.col("place") - F.col("size"))
    after = F.when(skip, at + 2).otherwise(at + 1)
    key = F.concat(F.substring("word", after, F.col("size")), F.lit(END), F.substring("word", F.lit(1), at))
    letter = F.when(skip, F.substring("word", at + 1, F.lit(1)))
    first = skip & ((at == 0) | (letter != F.substring("word", at, F.lit(1))))
    return each.select(F.col("word").alias("id"), "n", key.alias("key"), letter.alias("letter"), first.alias("first"))


def long_id(word: str) -> str:
    return "#" + hashlib.sha256(word.encode()).hexdigest()


def long_entries(word: str) -> Iterator[tuple[str, str | None, bool]]:
    """(key, letter, first) of the prefixes of over LONG code points, in time in proportion to the word."""
    codes = [ord(c) for c in word]
    size, run, power = len(codes), [0], [1]
    for c in codes:
        run.append((run[-1] * _BASE + c) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    power.append(power[-1] * _BASE % _PRIME)
    tail = lambda i: (run[size] - run[i] * power[size - i]) % _PRIME
    key = lambda i, j: f"#{((tail(j) * _BASE + ord(END)) * power[i] + run[i]) % _PRIME:032x}"  # noqa: E731  tail from j, terminator, head up to i
    if size > LONG:
        for i in range(size):
            yield key(i, i + 1), word[i], not i or codes[i] != codes[i - 1]
    if size + 1 > LONG:
        for i in range(size + 1):
            yield key(i, i), None, False


def _long(rows: DataFrame) -> DataFrame:
    """Entries of (word, n) whose prefixes are longer; a word of over LONG code points has its digest as id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["id", "n", "key", "letter", "first"])

        for batch in batches:
            held: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = long_id(word) if len(word) > LONG else word
                for key, letter, first in long_entries(word):
                    held.append((name, n, key, letter, first))
                    if len(held) == 1 << 14:
                        yield out(held)
                        held = []
            if held:
                yield out(held)

    return in_batches(rows.select("word", "n"), work, _ENTRY)


def scanned(entries: DataFrame) -> DataFrame:
    """(id, near, best_n, best): of each entry, how many neighbours its range holds, and the first of them by n and word.

    A row that holds a whole word and mistyped ones has two rows, a first neighbour of each kind.
    """
    by = Window.partitionBy("key")
    order = by.orderBy(F.desc("n"), F.asc_nulls_last("letter")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    skipped, item = F.col("letter").isNotNull(), F.struct("n", "id", "letter")
    nth = lambda on, k: F.nth_value(F.when(on, item), k, ignoreNulls=True).over(order)
    seen = entries.select("*", nth(skipped, 1).alias("one"), nth(skipped, 2).alias("two"), nth(F.col("first"), 1).alias("lead"), nth(~skipped, 1).alias("whole"), F.count_if(skipped).over(by).alias("n_skipped"), F.count_if("first").over(by).alias("n_first"))
    other = F.when(F.col("one.letter") == F.col("letter"), F.col("two")).otherwise(F.col("one"))
    met = F.col("first") & F.col("whole").isNotNull()
    near = F.when(skipped, F.col("n_skipped") - 1 + met.cast("long")).otherwise(F.col("n_first"))
    best = F.when(skipped, F.array(other, F.when(F.col("first"), F.col("whole")))).otherwise(F.array("lead"))
    found = seen.select("id", near.alias("near"), F.posexplode(F.array_compact(best)).alias("k", "b"))
    return found.select("id", F.when(F.col("k") == 0, F.col("near")).otherwise(0).alias("near"), F.col("b.n").alias("best_n"), F.col("b.id").alias("best"))


def neighbours(counted: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) of distinct words (word, n): how many words are one inserted, deleted or replaced letter away, and the most frequent of them, ties to the first in code-point order."""
    size, name = F.char_length("word"), F.concat(F.lit("#"), F.sha2(F.col("word").cast("binary"), 256))
    entries = _short(counted.where(size <= LONG)).unionByName(_long(counted.where(size >= LONG)))
    parts = cut(scanned(entries))
    far, names = F.startswith("best", F.lit("#")), counted.where(size > LONG).select(name.alias("best"), F.col("word").alias("text"))
    known = parts.where(~far).withColumn("text", F.col("best")).unionByName(parts.where(far).join(names, "best"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("best_n", "long"), ("text", "string"))]
    every = counted.select(F.when(size > LONG, name).otherwise(F.col("word")).alias("id"), "word", "n", F.lit(0).cast("long").alias("near"), *none)
    every = every.unionByName(known.select("id", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n"), "near", "best_n", "text"))
    first = F.min(F.when(F.col("text").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "text")))
    return every.groupBy("id").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.sum("near").alias("n_near"), first.alias("b")).select("word", "n", "n_near", F.col("b.text").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form (word, form): where following forms ends. A step doubles what is followed, and a form is more frequent than its word, so few steps are needed and none goes in a circle."""
    spark, k = forms.sparkSession, 0
    folder = shared_folder(spark, "roots")
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), f"{folder}/{k}")
    while now.where("moved").limit(1).count():
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        step = now.join(on, F.col("root") == F.col("_word"), "left")
        now = written(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), f"{folder}/{k + 1}")
        removed(spark, f"{folder}/{k}")
        k += 1
    return now.select("word", "root")


def grouped(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n)."""
    good = F.col("best_n") >= times * F.col("n")
    found = cut(neighbours(counted).select("word", F.when(good, F.col("best")).alias("form"), "n", "n_near", F.when(good, F.col("best_n")).alias("form_n")))
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(cut(words(table(spark, sf_dir, "documents"))))


ORACLE = """
with table_of as (select list_transform(range(256), lambda c: list_reduce(range(8), lambda a, x: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, c::bigint)) as t),
     runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
     once as (select doc_id, run, count(*) as k, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs group by doc_id, run),
     crc as (select *, xor(list_reduce(list_transform(range(0, len(x), 2), lambda i: ('0x' || x[i + 1:i + 2])::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295) as h from once, table_of),
     typed as (select case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from crc),
     words as (select word, sum(k)::bigint as n from typed where length(word) >= 5 group by word having sum(k) >= 3),
     cuts as (select word, n, i, left(word, i::int) || substr(word, i::int + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
     near as (select a.word, b.word as other, b.n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
              union select a.word, b.word, b.n from cuts a join words b on b.word = a.rest union select b.word, a.word, a.n from cuts a join words b on b.word = a.rest),
     best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as other_n from near group by word),
     forms as (select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when b.other_n >= 2 * w.n then b.other end as form, case when b.other_n >= 2 * w.n then b.other_n end as form_n from words w left join best b on b.word = w.word),
     ends as (with recursive follow as (select word, word as root from forms union all select f.word, g.form from follow f join forms g on g.word = f.root where g.form is not null) select f.word, f.root from follow f join forms g on g.word = f.root where g.form is null)
select f.word, f.form, e.root, f.n, f.n_near, f.form_n from forms f join ends e on e.word = f.word
"""
