"""Tags derived from paths, addresses, facts and vectors, and vectors kept by model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folder_tags, host_of, name_words, title_tags
from .aggregates import prototypes
from .joins import unit_vectors

#: Confidence of tags from names and from folders; the scale of logits and the least probability of a zero-shot label.
NAME, FOLDER, SCALE, SURE = 0.5, 0.6, 100.0, 0.40
#: Labels that are broadcast at once, items whose logits a task holds at once, and by how much equal logits may differ.
BLOCK_LABELS, ITEMS, TIE = 10_000, 1024, 1e-10


def _tag(name, source: str, confidence):
    return F.struct(name.alias("name"), F.lit(source).alias("source"), F.lit(confidence).cast("double").alias("confidence"))


def path_tags(files: DataFrame, depth: int = 2) -> DataFrame:
    """(asset_id, name, source, confidence) from files (asset_id, path, root_path, root_name); all locations add theirs."""
    names = F.transform(name_words(F.regexp_extract("path", "[^/]*$", 0)), lambda x: _tag(x, "heuristic", NAME))
    folders = F.transform(folder_tags("path", "root_path", depth), lambda x: _tag(x, "heuristic", FOLDER))
    root = F.when(F.col("root_name") != "", F.array(_tag(F.concat(F.lit("source:"), F.col("root_name")), "structural", None))).otherwise(F.array().cast("array<struct<name:string,source:string,confidence:double>>"))
    rows = files.select("asset_id", F.explode(F.concat(names, folders, root)).alias("t")).select("asset_id", "t.*")
    return rows.groupBy("asset_id", "name", "source").agg(F.max("confidence").alias("confidence"))


def vendor_tags(files: DataFrame) -> DataFrame:
    """(asset_id, name, source) for items with a file under a vendor's root (a column vendor)."""
    return files.where("vendor").select("asset_id", F.lit("vendor").alias("name"), F.lit("structural").alias("source")).distinct()


def link_tags(links: DataFrame) -> DataFrame:
    """(asset_id, name, source, confidence) from links (asset_id, url, title)."""
    titles = F.transform(F.coalesce(title_tags("title"), F.array().cast("array<string>")), lambda x: _tag(x, "heuristic", NAME))
    site = F.array(_tag(F.concat(F.lit("source:"), host_of("url")), "structural", None))
    return links.select("asset_id", F.explode(F.concat(site, titles)).alias("t")).select("asset_id", "t.*")


def fact_tags(attribute: DataFrame) -> DataFrame:
    """(asset_id, name, source) from attributes: animation where there are frames, has-alpha where there is alpha."""
    name = F.when((F.col("key") == "frame_count") & (F.col("value_num") > 1), "animation").when((F.col("key") == "has_alpha") & (F.col("value_num") > 0), "has-alpha")
    return attribute.select("asset_id", name.alias("name"), F.lit("structural").alias("source")).where("name is not null").distinct()


def zero_shot(vectors: DataFrame, labels: DataFrame, sure: float = SURE) -> DataFrame:
    """(id, namespace, name, confidence): at most one label for each item and namespace.

    vectors (id, v); labels (namespace, name, background, q) in which background rows compete but are never given; of
    equally likely labels the first by name. Labels are broadcast in blocks of BLOCK_LABELS. Of a block each item has,
    by namespace, its greatest logit, the sum of exponentials below it and the first label that has it, and those of
    several blocks are merged (a softmax needs no more), so a vocabulary may have any size. One block is decided where
    the items lie: nothing is shuffled.
    """
    rows = labels.select("namespace", "name", "background", F.transform("q", lambda x: x.cast("double")).alias("q"))
    blocks = max(1, -(-rows.count() // BLOCK_LABELS))
    items = vectors.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    parts = None
    for block in range(blocks):
        one = items.mapInArrow(_logits(rows, block, blocks), "id long, namespace string, top double, total double, name string, background boolean")
        parts = one if parts is None else parts.unionByName(one)
    if blocks > 1:
        # labels within rounding of the greatest logit tie, as in one block; the sums are taken below the common one
        top = F.max("top").over(Window.partitionBy("id", "namespace")).alias("_top")
        first = F.min(F.when(F.col("top") > F.col("_top") - TIE, F.struct("name", "background")))
        merged = parts.select("*", top).groupBy("id", "namespace").agg(F.max("_top").alias("top"), F.sum(F.col("total") * F.exp(F.col("top") - F.col("_top"))).alias("total"), first.alias("x"))
        parts = merged.select("id", "namespace", "top", "total", "x.name", "x.background")
    chance = 1 / F.col("total")
    return parts.where((chance >= sure) & ~F.col("background")).select("id", "namespace", "name", F.round(chance, 4).alias("confidence"))


def _logits(labels: DataFrame, block: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches (id, v): of each item and namespace of a block of labels the greatest logit, the sum of exponentials below it, and the first label by name that has it."""
    rows = labels.where(F.pmod(F.xxhash64("namespace", "name"), F.lit(blocks)) == block).orderBy("namespace", "name").toArrow()  # about BLOCK_LABELS
    spaces, names, background = (rows[c].to_pylist() for c in ("namespace", "name", "background"))
    known = unit_vectors(rows["q"].combine_chunks()) if rows.num_rows else {}
    shared = labels.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("id", pa.int64()), ("namespace", pa.string()), ("top", pa.float64()), ("total", pa.float64()), ("name", pa.string()), ("background", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (at, x) in unit_vectors(batch.column(1)).items():
                if n not in shared.value:
                    continue
                of, q = shared.value[n]
                ids = batch.column(0).to_numpy()[at]
                mine: dict = {}
                for k, i in enumerate(of.tolist()):
                    mine.setdefault(spaces[i], []).append(k)
                for step in range(0, len(ids), ITEMS):
                    logit = SCALE * (x[step : step + ITEMS] @ q.T)
                    for space, held in sorted(mine.items(), key=repr):
                        part = logit[:, held]
                        top = part.max(axis=1)
                        first = np.argmax(part > top[:, None] - TIE, axis=1)  # labels lie in order of name
                        label = of[np.array(held)[first]].tolist()
                        total = np.exp(part - top[:, None]).sum(axis=1)
                        columns = [ids[step : step + ITEMS], [space] * len(top), top, total, [names[k] for k in label], [background[k] for k in label]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return work


def label_matrix(prompts: DataFrame) -> DataFrame:
    """(namespace, name, background, q): the mean unit vector of each label's prompts (namespace, name, background, vector)."""
    return prototypes(prompts, ["namespace", "name", "background"]).withColumnRenamed("vector", "q")


def retag(asset_tag: DataFrame, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """asset_tag (asset_id, name, source, confidence) with its clip tags replaced by those of stored vectors."""
    new = zero_shot(vectors, labels).select(F.col("id").alias("asset_id"), "name", F.lit("clip").alias("source"), "confidence")
    seen = vectors.select(F.col("id").alias("asset_id"), F.lit("clip").alias("source"))
    return asset_tag.join(seen, ["asset_id", "source"], "left_anti").select("asset_id", "name", "source", "confidence").union(new)


def put_vectors(embedding: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with new ones (asset_id, model, vector): one for each item and model, the new one first."""
    o, n = embedding.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.asset_id") == F.col("n.asset_id")) & (F.col("o.model") == F.col("n.model")), "full_outer")
    return both.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("asset_id", "model", "vector")])
