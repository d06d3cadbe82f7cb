"""Full-text and hybrid retrieval: postings, BM25, fusion with vector rankings.

A search takes documents, whose words are then found anew, or a ``TextIndex`` stored once in a catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .filters import find
from .neighbours import VectorCells, palette_distance, palette_neighbours
from .ranking import placed, similar_by_hash, sort_keys, top_k, with_size
from .textindex import FIELDS, LEAST_IDF, MARKED, PLACES, PLAIN, Segments, TextIndex, occurrences, part, phrases, postings, tokens

#: Most vectors of a block of all pairs, blocks of a small table, and vectors a side of one matrix product.
PAIR_BLOCK, PAIR_PARTS, PAIR_STEP = 16384, 8, 512
#: The damping of fusion; the size and floor of the semantic side; neighbours.
DAMPING, SEMANTIC, FLOOR, NEIGHBOURS, NEIGHBOUR_FLOOR = 60, 120, 0.24, 60, 0.80


def match_all(docs: DataFrame | TextIndex, words: list[str], fields=None) -> DataFrame:
    """Ids of documents that hold every word, in any field; only words without a token match nothing."""
    index = TextIndex.of(docs, fields)
    found = phrases(index.sparkSession, words)
    if not found:
        return index.lengths.select("id").limit(0)
    return index.hits(found).groupBy("id").agg(F.countDistinct("i").alias("m")).where(F.col("m") == len(found)).select("id")


def bm25(docs: DataFrame | TextIndex, words: list[str], fields=None) -> DataFrame:
    """(id, score) of all documents that hold every word or phrase; the smaller the score the better.

    Hits are grouped by document, so no posting list is gathered.
    """
    index = TextIndex.of(docs, fields)
    found = phrases(index.sparkSession, words)
    if not found:
        return index.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = index.hits(found)
    df = hits.groupBy("i").agg(F.count("*").cast("double").alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    known = df.join(F.broadcast(index.totals())).select("i", idf.alias("idf"), "mean")  # a row for each phrase of the query
    each = F.col("idf") * part(F.col("n"), F.col("length"), F.col("mean"))
    scored = hits.join(F.broadcast(known), "i").groupBy("id").agg(F.sum(each).alias("s"), F.count("*").alias("m"))
    return scored.where(F.col("m") == len(found)).select("id", (-F.col("s")).alias("score"))


def best_matches(docs: DataFrame | TextIndex, words: list[str], k: int, within: DataFrame | None = None) -> DataFrame:
    """(id, score, rank) of the k best documents by ``bm25`` to PLACES decimals, ties by id; of those ``within`` (id), where given.

    A stored index reads only the blocks of documents that can hold one of them (``Segments.best``); where it cannot
    tell, and for documents without an index, all hits are scored.
    """
    top = docs.best(words, k, within) if isinstance(docs, Segments) else None
    if top is not None:
        rows = [(i, -s, rank) for rank, (s, i) in enumerate(top, 1)]
        return docs.sparkSession.createDataFrame(rows, "id bigint, score double, rank bigint")
    scores = bm25(docs, words).withColumn("score", F.round("score", PLACES))
    scores = scores if within is None else scores.join(within.select("id"), "id", "left_semi")
    first = scores.orderBy("score", "id").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")).cast("bigint"))  # k rows


def numbered(rows: DataFrame, score: str, ascending: bool = True) -> DataFrame:
    """(id, rank) of rows (id, score) by score and id, counted from 1; null scores come last. No task orders more than its part."""
    key = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return placed(rows.select("id", score), key, F.asc("id")).select("id", "rank")


def ranked(scores: DataFrame, ascending: bool = True, limit: int | None = None) -> DataFrame:
    """(id, rank) from scores (id, score), ties by id; with a limit only the best are ordered."""
    key = F.asc("score") if ascending else F.desc("score")
    if limit:
        return scores.orderBy(key, "id").limit(limit).select("id", F.row_number().over(Window.orderBy(key, "id")).cast("bigint").alias("rank"))
    return numbered(scores, "score", ascending)


def fuse(*rankings: DataFrame, damping: int = DAMPING) -> DataFrame:
    """(id, score, rank) by reciprocal-rank fusion of rankings (id, rank) that count from 1."""
    every = rankings[0].select("id", "rank")
    for r in rankings[1:]:
        every = every.union(r.select("id", "rank"))
    fused = settled(every.groupBy("id").agg(F.sum(1.0 / (damping + F.col("rank"))).alias("score")))
    return fused.join(numbered(fused, "score", ascending=False), "id")


def semantic(query: DataFrame, library: DataFrame | VectorCells, k: int = SEMANTIC, floor: float = FLOOR) -> DataFrame:
    """The vector side: the k nearest by cosine, then the floor. query: one row (query_id, q); library (id, v) or stored cells."""
    asked = query.select((-F.col("query_id") - 1).alias("query_id"), "q")  # a text, not a row of the library, so no row is its own
    return top_k(asked, library, k, floor).select((-F.col("query_id") - 1).alias("query_id"), "id", "score", "rank")


def search(catalog, docs: DataFrame | TextIndex, words: list[str], ranking: DataFrame | None = None, order_by: str | None = None, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
    """Items with a rank: those that hold all words, joined by those of a ranking (id, score, best first by score).

    Filters apply to both sides. With a ranking the fused rank is the order unless another is asked for (added, updated,
    name, size); text alone is by date added unless ``relevance`` is asked for; relevance without text is by date too.
    ``limit`` and ``offset`` take a page of the order; a page by relevance of a stored index reads what it needs
    (``best_matches``).
    """
    items = find(catalog, **filters)
    if words and ranking is None and order_by == "relevance" and limit is not None:
        page = best_matches(docs, words, offset + limit, items if filters else None).where(F.col("rank") > offset)
        return catalog.asset.join(page.select("id", "rank"), "id")
    literal = bm25(docs, words) if words else None
    if ranking is not None:
        sides = [ranked(ranking.select("id", "score"), ascending=False)]
        if literal is not None:
            sides.insert(0, ranked(literal))
        hits = items.join(fuse(*sides).select("id", F.col("rank").alias("_rank")), "id")
    elif literal is not None:
        hits = items.join(literal.withColumnRenamed("score", "_score"), "id")
    else:
        hits = items
    if order_by in (None, "relevance") and "_rank" in hits.columns:
        keys = [F.asc("_rank"), F.asc("id")]
    elif order_by == "relevance" and "_score" in hits.columns:
        keys = [F.asc_nulls_last("_score"), F.asc("id")]
    else:
        by = order_by if order_by in ("updated", "name", "size") else "added"
        hits, keys = with_size(hits, catalog.location) if by == "size" else hits, sort_keys(by)
    order = hits.select("id", *[k for k in ("added_at", "updated_at", "title", "max_size", "_rank", "_score") if k in hits.columns])
    # the ranking is settled and holds the ids that passed, so the search itself runs once however often its result is used
    ranks = placed(order, *keys).select("id", "rank")
    if offset or limit is not None:
        ranks = ranks.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit if limit is not None else F.lit(True)))
    return catalog.asset.join(ranks, "id")


def similar(queries: DataFrame, library: DataFrame | VectorCells, query_hashes: DataFrame, hashes: DataFrame) -> DataFrame:
    """query_id, id, rank: vector neighbours of each query, or its hash neighbours where it has none."""
    near = top_k(queries, library, NEIGHBOURS, NEIGHBOUR_FLOOR).select("query_id", "id", "rank")
    rest = query_hashes.join(near.select("query_id").distinct(), "query_id", "left_anti")
    return near.union(similar_by_hash(rest, hashes).select("query_id", "id", "rank"))


def evaluate(ranking: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean precision at k and mean reciprocal rank of rankings (query_id, id, rank) against pairs (query_id, id)."""
    hit = ranking.join(truth.select("query_id", "id", F.lit(True).alias("hit")), ["query_id", "id"], "left")
    each = hit.groupBy("query_id").agg((F.count_if(F.col("hit") & (F.col("rank") <= k)) / F.lit(float(k))).alias("p"), F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("r"))
    return each.agg(F.avg("p").alias("precision"), F.avg("r").alias("mrr"))


def pair_percentiles(library: DataFrame, percents: tuple[float, ...] = (0.01, 0.5, 0.99), step: float = 1e-3) -> DataFrame:
    """percent and cosine: percentiles over all pairs of unit vectors (id, v), to within ``step``.

    Vectors are dealt into blocks; every pair of blocks is a few matrix products in one task, which counts their cells as
    they come and sends only a histogram, so neither what a task holds nor what leaves it grows with its pairs. A vector is
    sent, as it is stored, once for each block: there are PAIR_PARTS for a small table, and more only as blocks would pass
    PAIR_BLOCK vectors.
    """
    import numpy as np
    import pyarrow as pa

    bins = int(round(2 / step)) + 1
    rows = library.where("v is not null").select("id", "v")
    many = rows.count()
    blocks = max(1, -(-many // PAIR_BLOCK), min(PAIR_PARTS, -(-many // PAIR_STEP)))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    pairs = dealt.select("v", "b", others).select("v", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def histogram(table: pa.Table) -> pa.Table:
        column = table["v"].combine_chunks()
        v, b = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1), table["b"].to_numpy()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        x, y = v[b == lo], v[b == hi]
        n = np.zeros(bins, np.int64)
        for i in range(0, len(x), PAIR_STEP):
            for j in range(i if lo == hi else 0, len(y), PAIR_STEP):
                s = x[i : i + PAIR_STEP] @ y[j : j + PAIR_STEP].T
                s = s[np.triu_indices(len(s), 1)] if lo == hi and i == j else s.ravel()
                n += np.bincount(np.rint((np.clip(s, -1, 1) + 1) / step).astype(np.int32), minlength=bins)
        at = np.flatnonzero(n)
        return pa.table({"bin": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    counts = pairs.groupBy("lo", "hi").applyInArrow(histogram, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    below = counts.withColumn("c", F.sum("n").over(Window.orderBy("bin"))).withColumn("t", F.sum("n").over(Window.partitionBy()))  # at most 2 / step rows
    out = below.select("*", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")).where(F.col("c") >= F.col("percent") * F.col("t"))
    return out.groupBy("percent").agg((F.min("bin") * step - 1).alias("cosine"))


__all__ = ["FIELDS", "MARKED", "PLAIN", "Segments", "TextIndex", "best_matches", "bm25", "evaluate", "fuse", "match_all", "numbered", "occurrences", "pair_percentiles", "palette_distance", "palette_neighbours", "phrases", "postings", "ranked", "search", "semantic", "similar", "tokens"]
