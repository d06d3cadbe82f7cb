"""A corpus pipeline of five of the training-data operators; each stage's result is written before the next reads it.

Every stage but the last returns rows of ``documents`` with all their columns; the last returns what training reads.
An empty table passes through all stages. Null texts are in no language, so the first stage drops them.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from larder.llm import bpe, decontaminate, langid, quality, simhash
from larder.llm.common import shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified."""
    return langid.kept(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are likelier above the lowest quality grade than in it."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near copies."""
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded text."""
    return bpe.digests(docs)


STAGES = [("language", language), ("quality", good), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("tokens", tokens)]
#: No stage but the last could be said in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
