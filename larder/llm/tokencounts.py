"""Token counts as delta-maintained rollups.

A batch is a table of signed changes: an insert adds a document's tokens, a delete takes them away, a revised count
adds the difference. Changes are summed by source, language and tokenizer version before anything is written, so a
batch on disk is a few rows and totals are the sum of all batches. A batch is written aside and commits by one rename
to the folder of its identifier, which fails if the folder is there: of several writers one commits, committing an
identifier again changes nothing, a job may be retried after any failure, and an attempt that did not finish is in
no total. (The rename is atomic where the file system's is, as in HDFS.) ``compact`` sums the batches so far into one
base in the same way; totals are the newest base and the batches that it does not hold.

Null source or language is a group of its own. A null or empty text has no tokens but counts as a document. Repeated
rows in a batch are separate changes. A null count is no tokens. An empty batch commits and adds no rows. Totals of
groups whose documents are all gone show zero documents. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import cut, in_batches, shared_folder, sized, table

#: Tokenizer versions that SQL can count too: what a token is.
TOKENIZERS = {"words/1": r"[^\x20\x09-\x0D]+", "words/2": r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"}
#: An e-mail address or a link.
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|https?://[^\x20\x09-\x0D]+"
KEYS = ("source", "lang", "tokenizer")


def counts(docs: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer and n_tokens, a row for each document and tokenizer version."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = [F.struct(F.lit(v).alias("tokenizer"), F.regexp_count(text, F.lit(p)).cast("long").alias("n_tokens")) for v, p in (versions or TOKENIZERS).items()]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*each)).alias("x")).select("doc_id", "source", "lang", "x.*")


def bpe_counts(docs: DataFrame, rank_file: str = bpe.RANKS) -> DataFrame:
    """As ``counts``, by the byte-level BPE of a rank file; the tokenizer version is ``bpe/`` and the file's name."""
    version = "bpe/" + rank_file.rsplit("/", 1)[-1].removesuffix(".tiktoken")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(bpe.encode(text.as_py(), rank_file)) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    return docs.select("doc_id", "source", "lang", "text").transform(in_batches, work, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def inserted(rows: DataFrame) -> DataFrame:
    """Counted documents as changes that add them."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("n_tokens", F.lit(0).cast("long")).alias("tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    """Counted documents as changes that take them away."""
    return inserted(rows).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(rows: DataFrame) -> DataFrame:
    """Documents with an old and a new count (old_tokens, n_tokens) as changes by the difference."""
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), (value("n_tokens") - value("old_tokens")).alias("tokens"))


class Rollup:
    """Additive totals under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _there(self, name: str) -> list[str]:
        """Names of the folders under ``path`` that begin so."""
        root = self._fs.Path(self.path)
        fs = root.getFileSystem(self._conf)
        return sorted(x.getPath().getName() for x in fs.globStatus(self._fs.Path(root, name + "*")) or [])

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Write rows aside and give them their name in one step; False if another has it."""
        aside = f"{self.path}/_writing-{uuid4().hex}"
        rows.write.parquet(aside)
        files = self._fs.FileContext.getFileContext(self._fs.Path(aside).getFileSystem(self._conf).getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            files.rename(self._fs.Path(aside), self._fs.Path(f"{self.path}/{name}"), none)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            self._fs.Path(aside).getFileSystem(self._conf).delete(self._fs.Path(aside), True)
            return False
        return True

    def _parts(self) -> tuple[list[str], str | None, int]:
        """Committed batches, the newest base and the number of bases."""
        bases = self._there("base=")
        return [x.removeprefix("batch=") for x in self._there("batch=")], f"{self.path}/{bases[-1]}" if bases else None, len(bases)

    def committed(self, batch: str) -> bool:
        """Whether a batch counts in the totals."""
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError("a batch identifier has letters, digits, and -_. only")
        return f"batch={batch}" in self._there(f"batch={batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes (KEYS, docs, tokens) unless its identifier has been committed; whether it was added."""
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
        return self._publish(sums.withColumns({"changed": F.array(F.lit(batch))}), f"batch={batch}")

    def _rows(self, names: list[str], base: str | None) -> DataFrame:
        """KEYS, docs, tokens and the batches that changed them (a base has several to a row), of these batches and a base; a tokenizer is never null but in the row that says what a base holds."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long, changed array<string>"
        read = lambda paths: self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        held = set()
        if base:
            held = {r[0] for r in self.spark.read.parquet(base).where("tokenizer is null").select(F.explode("changed")).collect()}  # names of batches
        rows = read([f"{self.path}/batch={x}" for x in names if x not in held])
        return rows.union(read([base]).where("tokenizer is not null")) if base else rows

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens and the number of batches that changed them."""
        each = F.size(F.array_distinct(F.flatten(F.collect_list("changed"))))
        names, base, _ = self._parts()
        return self._rows(names, base).groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"), each.alias("n_batches"))

    def compact(self) -> bool:
        """Sum the batches that are committed now into a new base; whether this call did it. Their folders stay: they are what says that they are committed."""
        names, base, n = self._parts()
        each = F.array_distinct(F.flatten(F.collect_list("changed")))
        sums = self._rows(names, base).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), each.alias("changed"))
        marker = self.spark.createDataFrame([(None, None, None, 0, 0, names)], sums.schema)  # what the base holds
        return self._publish(sums.union(marker), f"base={n:09d}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, those of low quality deleted, those with addresses recounted without them; the second batch is sent twice."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), table(spark, sf_dir, "labels")
    poor = sized(labels.where("quality = 0 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct())
    rollup = Rollup(spark, shared_folder(spark, "rollup"))
    rollup.commit("0-insert", inserted(counts(docs)))
    gone = deleted(counts(docs.join(poor, F.col("doc_id") == F.col("_id"), "left_semi")))
    rollup.commit("1-delete", gone)
    rollup.commit("1-delete", gone)
    held = docs.where(F.col("text").rlike(ADDRESS)).join(poor, F.col("doc_id") == F.col("_id"), "left_anti")
    shorter = F.regexp_replace("text", ADDRESS, " ")
    both = [F.struct(F.lit(v).alias("tokenizer"), F.regexp_count("text", F.lit(p)).alias("old_tokens"), F.regexp_count(shorter, F.lit(p)).alias("n_tokens")) for v, p in TOKENIZERS.items()]
    rollup.commit("2-revise", revised(held.select("source", "lang", F.explode(F.array(*both)).alias("x")).select("source", "lang", "x.*")))
    return rollup.totals().drop("n_batches")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches counted by byte-level BPE, the tokenizer that ``op9`` encodes with."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), table(spark, sf_dir, "labels")
    poor = sized(labels.where("quality = 0 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct())
    rollup, counted = Rollup(spark, shared_folder(spark, "rollup")), cut(bpe_counts(docs))
    rollup.commit("0-insert", inserted(counted))
    rollup.commit("1-delete", deleted(counted.join(poor, F.col("doc_id") == F.col("_id"), "left_semi")))
    held = docs.where(F.col("text").rlike(ADDRESS)).join(poor, F.col("doc_id") == F.col("_id"), "left_anti")
    shorter = held.withColumn("text", F.regexp_replace("text", ADDRESS, " "))
    for name, part, sign in (("2-take", held, deleted), ("3-give", shorter, inserted)):
        rollup.commit(name, sign(bpe_counts(part)))
    return rollup.totals().drop("n_batches")


_COUNT = "len(regexp_extract_all(text, '{}'))::bigint"
ORACLE = f"""
with kept as (select source, lang, regexp_replace(coalesce(text, ''), '{ADDRESS}', ' ', 'g') as text from documents
              where coalesce(doc_id not in (select doc_id from labels where quality = 0 and doc_id is not null), true)),
     counted as ({" union all ".join(f"select source, lang, '{v}' as tokenizer, 1 as docs, {_COUNT.format(p)} as tokens from kept" for v, p in TOKENIZERS.items())}),
     sums as (select source, lang, tokenizer, sum(docs) as docs, sum(tokens) as tokens from counted group by all),
     every as (select * from (select distinct source, lang from documents), (values {", ".join(f"('{v}')" for v in TOKENIZERS)}) v(tokenizer))
select e.source, e.lang, e.tokenizer, coalesce(s.docs, 0)::bigint as n_docs, coalesce(s.tokens, 0)::bigint as n_tokens
from every e left join sums s on s.source is not distinct from e.source and s.lang is not distinct from e.lang and s.tokenizer = e.tokenizer
"""
