"""Exact top-k search by inner product with a three-phase uniform threshold.

The axes of a vector form ``NODES`` blocks, each a node with local scores: a block's part of the inner product.
Phase 1 gathers, for each query, the local score lists: the k best candidates of each block. Only what is listed is
summed; the k-th best of those sums over all tasks is a safe cutoff, which is broadcast.
Phase 2 collects sufficient entries: a candidate at or above the cutoff has a block at or above cutoff / NODES, so
lower parts are not sent; an entry is collected if the parts sent, and cutoff / NODES for each not sent, reach the cutoff.
Phase 3 resolves what remains: of the entries collected the parts that were not sent are looked up (a row holds its
blocks, so in the same task), and the scores of those that still reach the cutoff are summed exactly and ranked.

Queries are dealt by hash to blocks of about ``QUERY_BLOCK``, so what is broadcast has a fixed bound; every block meets
all rows; matrices of local scores are bounded by ``CELLS``, whatever the numbers of queries and rows. Ties go to the
smaller vec_id. A vector that is null, empty or holds a null or non-finite component takes no part, nor does one without
vec_id; vectors of different lengths are not compared. Rows that repeat a vec_id are one query (the least vector of them
asks) and separate candidates with equal ids, never candidates of their own id. With fewer than k candidates all are
returned, with none the query has no rows. Columns other than vec_id and embedding are not read. The phases compare in
doubles with a margin for rounding and the last sum is of whole numbers, so results are exact. Components of 2^62 or more
in size raise, and so does a score that may be among the k best and is no 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_batches, table

#: Results of a query, blocks of axes, queries broadcast at once, local scores and entries held at once, the largest component, and the margin for rounding in parts of the vectors' norms.
K, NODES, QUERY_BLOCK, CELLS, LARGEST, MARGIN = 10, 2, 8192, 1 << 20, 1 << 62, 1e-9


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v, the whole-number components floor(1024 x), of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    big = F.exists(x, lambda c: F.abs(1024 * c) >= LARGEST)
    v = F.transform(x, lambda c: F.floor(1024 * c).cast("bigint"))
    return rows.where(sound).select("vec_id", F.when(big, F.raise_error(F.lit("a component is too large"))).otherwise(v).alias("v"))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: positions of the vectors of that length and their matrix of whole numbers."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return {int(n): (at := np.flatnonzero(sizes == n), flat[(starts[at][:, None] + np.arange(n))]) for n in np.unique(sizes)}


def _margin(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What rounding may change of the scores of queries and rows, in doubles (queries x rows)."""
    return MARGIN * (1 + np.linalg.norm(q.astype(float), axis=1)[:, None] * np.linalg.norm(x.astype(float), axis=1)[None, :])


def _axes(n: int, nodes: int) -> list[slice]:
    edges = [round(k * n / nodes) for k in range(nodes + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _batches(batches: Iterator[pa.RecordBatch], held: dict, nodes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Of every set of rows of a length that queries have: query ids, query matrix, row ids, row matrix, local scores of each block (queries x rows)."""
    for batch in batches:
        for n, (at, rows) in _matrix(batch.column(1)).items():
            if n not in held:
                continue
            qid, q = held[n]
            ids, wide = batch.column(0).to_numpy()[at], q.astype(float)
            step = max(16, CELLS // len(qid))
            for k in range(0, len(ids), step):
                x = rows[k : k + step]
                yield qid, q, ids[k : k + step], x, [wide[:, s] @ x[:, s].T.astype(float) for s in _axes(n, nodes)]


def listed(parts: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: for each query the sums of the candidates in the local lists (the k best of each block, ``own`` aside), -inf where a list repeats one."""
    m = min(k + 1, own.shape[1])  # one more, for the query itself
    names = np.sort(np.concatenate([np.argpartition(-p, m - 1, axis=1)[:, :m] for p in parts], axis=1), axis=1)
    sums = sum(np.take_along_axis(p, names, axis=1) for p in parts)
    sums[:, 1:][names[:, 1:] == names[:, :-1]] = -np.inf
    sums[np.take_along_axis(own, names, axis=1)] = -np.inf
    return sums


def sufficient(parts: list[np.ndarray], own: np.ndarray, least: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Phase 2: query and row of every entry collected, the sum of its parts that are sent, and for each block whether its part was."""
    even = np.where(np.isfinite(least), least / len(parts), -1e300)[:, None]
    sent = [p >= even - margin for p in parts]
    some = np.logical_or.reduce(sent) & ~own
    bound = sum(np.where(s, p, even) for s, p in zip(sent, parts, strict=True))
    at, col = np.nonzero(some & (bound >= least[:, None] - margin))
    sent = [s[at, col] for s in sent]
    return at, col, sum(np.where(s, p[at, col], 0) for s, p in zip(sent, parts, strict=True)), sent


def resolved(q: np.ndarray, x: np.ndarray, parts: list[np.ndarray], entries: tuple, least: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 3: query, row and exact score of the entries that reach the cutoff once the parts that were not sent are added."""
    at, col, total, sent = entries
    for s, p in zip(sent, parts, strict=True):
        missing = np.flatnonzero(~s)
        total[missing] += p[at[missing], col[missing]]
    left = np.flatnonzero(total >= least[at] - margin[at, col])
    at, col, total = at[left], col[left], total[left]
    step = max(1, CELLS // q.shape[1])
    # sums of 64-bit numbers are right modulo 2^64, whatever lies between, so they are right where the score is such a number
    exact = np.concatenate([np.zeros(0, np.int64), *[(q[at[i : i + step]] * x[col[i : i + step]]).sum(axis=1) for i in range(0, len(at), step)]])
    for i in np.flatnonzero(np.abs(total) + margin[at, col] >= 2.0**63).tolist():
        if not -(1 << 63) <= sum(a * b for a, b in zip(q[at[i]].tolist(), x[col[i]].tolist(), strict=True)) < 1 << 63:
            raise OverflowError("a score is no 64-bit number")
    return at, col, exact


def _search(queries: dict, rows: DataFrame, k: int, nodes: int) -> DataFrame:
    """query_id, vec_id and score of all entries that may be among the k best, for one block of queries."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)  # about QUERY_BLOCK vectors

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # by length: the k best sums of each query
        for qid, q, ids, x, parts in _batches(batches, shared.value, nodes):
            parts[0] -= _margin(q, x)  # no sum is above the score, so the cutoff is not
            sums = listed(parts, ids[None, :] == qid[:, None], k)
            if (n := q.shape[1]) in best:
                sums = np.concatenate([best[n], sums], axis=1)
            best[n] = -np.partition(-sums, k - 1, axis=1)[:, :k] if sums.shape[1] > k else sums
        for n, sums in best.items():
            at, col = np.nonzero(np.isfinite(sums))
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[n][0][at]), pa.array(sums[at, col])], names=["query_id", "total"])

    lists = rows.transform(in_batches, gather, "query_id long, total double")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"))))
    cutoffs = dict(ranked.where(F.col("rank") == k).select("query_id", "total").collect())  # a number for each query of the block
    cutoff = rows.sparkSession.sparkContext.broadcast({n: np.array([cutoffs.get(i, -np.inf) for i in qid.tolist()]) for n, (qid, _) in queries.items()})

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qid, q, ids, x, parts in _batches(batches, shared.value, nodes):
            least, margin = cutoff.value[q.shape[1]], _margin(q, x)
            entries = sufficient(parts, ids[None, :] == qid[:, None], least, margin)
            at, col, score = resolved(q, x, parts, entries, least, margin)
            yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(ids[col]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return rows.transform(in_batches, collect, "query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, nodes: int = NODES, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates but itself; both tables are vectors() rows."""
    rows = cut(candidates)
    asked = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = -(-asked.count() // block)
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    for i in range(blocks):
        taken = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if taken.num_rows:
            ids = taken["vec_id"].to_numpy()
            held = {size: (ids[at], matrix) for size, (at, matrix) in _matrix(taken["v"].combine_chunks()).items()}
            found = found.union(cut(_search(held, rows, k, nodes)))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = len(embedding)),
     s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
           from v q, v c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
     r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
