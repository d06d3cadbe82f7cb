"""The joins of the catalogue that are not filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem

#: Queries that are broadcast at once, and scores that a task holds at once.
QUERIES, CELLS = 2048, 1 << 21
# What the name of a model's preview may end with, and its extensions.
PREVIEW_SUFFIXES = ("", "_preview", "_thumb", "_thumbnail", "_icon", "-preview")
PREVIEW_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "tga", "bmp")


def count_right(left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: Column | None = None, distinct: str | None = None, name: str = "n") -> DataFrame:
    """left with the number of its right rows, zero kept; ``on`` is part of the join, so it drops no left row."""
    rows = right if on is None else right.where(on)
    counts = rows.groupBy(F.col(right_key).alias("_k")).agg((F.countDistinct(distinct) if distinct else F.count("*")).alias(name))
    return left.join(counts, left[left_key] == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def text_scored(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Items that a text search found, with their score."""
    return items.join(scores.select(F.col("id").alias("_s"), "score"), items["id"] == F.col("_s")).drop("_s")


def score_all(queries: DataFrame, library: DataFrame, score: Callable[[str, str], Column]) -> DataFrame:
    """(query_id, id, score) of a stated set of queries (query_id, q) against a whole library (id, v).

    Queries are gathered into blocks of at most about QUERIES, and every library row meets each block in an equi-join on
    the block's number; a single block is broadcast and the library streams past once.
    """
    blocks = max(1, -(-queries.count() // QUERIES))
    dealt = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("query_id", "q")).alias("_qs"))
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    met = library.withColumn("_b", each).join(F.broadcast(dealt) if blocks == 1 else dealt, "_b")
    return met.select("id", "v", F.inline("_qs")).select("query_id", "id", score("q", "v").alias("score"))


def unit_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions and unit vectors of the vectors that have a direction."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    flat, starts = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()[:-1]
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        x = flat[starts[at][:, None] + np.arange(n)]
        norm = np.sqrt((x * x).sum(axis=1))
        sound = np.isfinite(norm) & (norm > 0)
        out[n] = at[sound], x[sound] / norm[sound][:, None]
    return out


def nearest(queries: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each partition of a library (id, v) the k rows nearest by cosine to each query (query_id, q) but itself.

    Queries are made unit vectors once and broadcast in blocks of QUERIES; each batch of the library is one matrix
    product with a block. Scores near a query's k-th best are summed again one by one, so that equal vectors tie
    wherever they lie. Rows of another length, null or without a direction have no score.
    """
    sc, rows = library.sparkSession.sparkContext, library.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    asked = queries.select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
    many = asked.count()
    blocks, out = max(1, -(-many // QUERIES)), None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        ids = part["query_id"].to_numpy()
        found = unit_vectors(part["q"].combine_chunks()) if part.num_rows else {}
        held = sc.broadcast({n: (ids[at], unit) for n, (at, unit) in found.items()})  # about QUERIES vectors

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # query, id, score
            for batch in batches:
                for n, (at, x) in unit_vectors(batch.column(1)).items():
                    if n not in held.value:
                        continue
                    qid, q = held.value[n]
                    names = batch.column(0).to_numpy()[at]
                    step = max(k, CELLS // len(qid))
                    for i in range(0, len(names), step):
                        score = np.where(qid[:, None] == names[None, i : i + step], -np.inf, q @ x[i : i + step].T)
                        if score.shape[1] > k:
                            least = -np.partition(-score, k - 1, axis=1)[:, k - 1] - 1e-9
                        else:
                            least = np.full(len(qid), -np.inf)
                        row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                        exact = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[row[j : j + 65536]], x[i + col[j : j + 65536]]) for j in range(0, len(row), 65536)]])
                        new = row, names[i + col], exact
                        if n in best:
                            new = tuple(np.concatenate(z) for z in zip(best[n], new, strict=True))
                        order = np.lexsort((new[1], -new[2], new[0]))
                        first = np.searchsorted(new[0][order], np.arange(len(qid)))
                        kept = order[np.arange(len(order)) - first[new[0][order]] < k]
                        best[n] = tuple(z[kept] for z in new)
            for n, (row, names, score) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(held.value[n][0][row], pa.int64()), pa.array(names, pa.int64()), pa.array(score)], names=["query_id", "id", "score"])

        one = rows.mapInArrow(work, "query_id long, id long, score double")
        out = one if out is None else out.union(one)
    return out


def owner_root(files: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Files with the id of the longest root path that is above them, null without one.

    A path has as many candidate roots as folders, so each file offers those to an equi-join.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    offered = files.select(path, F.explode(above).alias("_root")).distinct()
    owners = offered.join(roots.select(F.regexp_replace("path", "(?<=.)/+$", "").alias("_root"), F.col("id").alias("root_id")), "_root")
    best = owners.groupBy(F.col(path).alias("_path")).agg(F.max_by("root_id", F.length("_root")).alias("root_id"))
    return files.join(best, files[path] == F.col("_path"), "left").drop("_path")


def merge_keyed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the new row's values win where both have one."""
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns])


def previews(models: DataFrame, images: DataFrame) -> DataFrame:
    """(model_path, preview): the first by name of the images in a model's folder that are named after it."""
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    found = images.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*PREVIEW_EXTENSIONS)).select(folder("path").alias("dir"), F.col("path").alias("image"), F.lower(stem(name("path"))).alias("base"))
    bases = [F.when(F.lit(not s) | F.endswith("base", F.lit(s)), F.expr(f"left(base, length(base) - {len(s)})")) for s in PREVIEW_SUFFIXES]
    keyed = found.select("dir", "image", F.explode(F.array_distinct(F.array_compact(F.array(*bases)))).alias("key"))
    wanted = models.select(F.col("path").alias("model_path"), folder("path").alias("dir"), F.lower(stem(name("path"))).alias("key"))
    return wanted.join(keyed, ["dir", "key"]).groupBy("model_path").agg(F.min("image").alias("preview"))
