"""Nearest rows by hash, vector and palette without meeting every row: multi-index hashing, cells of vectors, and a grid of palettes. All are exact."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import hamming
from ..sources.catalog import Catalog, Snapshot
from ..sources.shared import settled
from .joins import CELLS, QUERIES, unit_vectors

#: A 64-bit hash is so many bands of so many bits; buckets are probed up to so many bits from a query's, then the rest is scanned.
BANDS, WIDTH, FAR = 4, 16, 3
#: Pairs that are scanned while one is met in a join, pairs that are met whatever a scan would cost, and pairs that a task scans.
PROBE, FREE, SCAN = 128, 1 << 20, 1 << 29
#: Vectors that centroids are learned from, rounds of learning, most cells, and rows that a cell has at least on average.
SAMPLE, ROUNDS, MOST_CELLS, PER_CELL = 8192, 8, 1024, 64
#: Steps of a channel in the grid of palettes, and pairs of palettes that a task compares.
GRID, PALETTES = 8, 1 << 26
#: By how much rounding may move a distance of unit vectors.
MARGIN = 1e-7
NAME = "cells"
_CELL = "id bigint, v array<double>, cell int"
_CENTRE = "cell int, centroid array<double>, size int, radius double, n bigint"


def band_values(v: Column) -> Column:
    """The bands of a hash, lowest first."""
    return F.array(*[F.shiftrightunsigned(v, WIDTH * b).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int") for b in range(BANDS)])


def first_ids(library: DataFrame, k: int) -> DataFrame:
    """(id, v): of rows of one hash the k first, so that a hash that a third of all rows share is no group of its own."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))  # each task sends k rows of a hash at most
    return library.where("v is not null").select("id", "v", rank.alias("_r")).where(F.col("_r") <= k).select("id", "v")


def _best(rows: DataFrame, k: int, by: str = "query_id", tie: str = "id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy("distance", tie))
    return rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def hash_neighbours(queries: DataFrame, library: DataFrame, k: int, most: int) -> DataFrame:
    """query_id, id, distance, rank of the k hashes (id, v) nearest to each query (query_id, q) but itself, within ``most`` bits, ties by id.

    Different queried hashes meet different hashes, each once, with the number of its rows and the first of them: the k + 1
    first rows are among those of the k + 1 first hashes by distance and first row. Only these are put back into rows, and
    those given to all queries of a hash, so what is met does not grow with copies on either side.

    Hashes within BANDS * (s + 1) - 1 bits differ by s bits at most in some band, so buckets of bands are probed by growing
    s, an equi-join each, until a query has more than k rows within that: nothing nearer is left. A pair counts in
    the one bucket where its bands are nearest first. What is not decided after FAR bits, or when probes and what they
    would meet are more than FREE and than one in PROBE of all pairs, is decided by a scan that sends k + 1 hashes a query and task.
    """
    held = settled(first_ids(library, k + 1))
    values = settled(held.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    table = settled(values.select("v", "first", "n", F.posexplode(band_values(F.col("v"))).alias("band", "part")))
    sizes = settled(table.groupBy("band", "part").agg(F.count("*").alias("_met")))  # at most BANDS * 2 ** WIDTH
    many = values.count()
    pending = settled(queries.where("q is not null").select("q").distinct())
    left, found = pending.count(), None
    for s in range(FAR + 1):
        if BANDS * comb(WIDTH, s) * PROBE > many or not left:
            break
        masks = F.array(*[F.lit(sum(1 << b for b in bits)) for bits in combinations(range(WIDTH), s)])
        asked = pending.select("q", F.posexplode(band_values(F.col("q"))).alias("band", "_own")).select("q", "band", F.explode(masks).alias("_mask"), "_own")
        asked = asked.select("q", "band", F.col("_own").bitwiseXOR(F.col("_mask")).alias("part"))
        meets = asked.join(F.broadcast(sizes), ["band", "part"], "left").agg(F.sum(1 + F.coalesce("_met", F.lit(0)))).first()[0]
        if meets > FREE and meets * PROBE > left * many:
            break
        met = asked.join(table.hint("merge"), ["band", "part"])  # probes are many more than their queries, by whose size Spark would hold them
        apart = F.zip_with(band_values(F.col("q")), band_values(F.col("v")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        first = F.array_position(F.transform(apart, lambda d: d == F.array_min(apart)), F.lit(True)) - 1  # the nearest band, or the first of them
        new = met.where((first == F.col("band")) & (hamming("q", "v") <= most)).select("q", "v", "first", "n", hamming("q", "v").alias("distance"))
        found = settled(_best(new if found is None else found.unionByName(new), k + 1, "q", "first").drop("rank"))
        sure = BANDS * (s + 1) - 1
        if sure >= most:
            left = 0
            break
        done = found.where(F.col("distance") <= sure).groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") > k)
        pending = settled(pending.join(done, "q", "left_anti"))
        left = pending.count()
    if left:
        scan = _best(_scan(pending, values, k + 1).where(F.col("distance") <= most), k + 1, "q", "first").drop("rank")
        found = scan if found is None else found.join(pending, "q", "left_anti").unionByName(scan.select(*found.columns))
    elif found is None:
        found = values.limit(0).select(F.col("v").alias("q"), "v", "first", "n", F.lit(0).alias("distance"))
    nearer = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = settled(found).withColumn("_nearer", nearer).where(F.col("_nearer") <= k)
    rows = _best(near.select("q", "v", "distance").join(held, "v").select("q", "id", "distance"), k + 1, "q").drop("rank")
    return _best(queries.select("query_id", "q").distinct().join(rows, "q").where("query_id <> id").select("query_id", "id", "distance"), k)


def _scan(queries: DataFrame, values: DataFrame, k: int) -> DataFrame:
    """(q, v, first, n, distance): of each task's hashes (v, first, n) the k nearest to each query (q), ties by ``first``.

    Queries are broadcast in blocks of QUERIES; hashes are dealt to so many tasks that each compares about SCAN pairs of
    all blocks, so that no task grows with the tables.
    """
    many = queries.count()
    sc, blocks, out = values.sparkSession.sparkContext, max(1, -(-many // QUERIES)), None
    dealt = values.select("v", "first", "n").repartition(int(max(1, -(-many * values.count() // SCAN))))
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q").toArrow().combine_chunks()
        held = sc.broadcast(part["q"].to_numpy().view(np.uint64))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q = held.value
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # query, distance, first, v, n
            least = np.full(len(q), 65, np.uint8)  # beyond that nothing is nearer than what a query has
            for batch in batches if len(q) else ():
                v, first, n = (c.to_numpy() for c in batch.columns)
                for i in range(0, len(v), step := max(k, CELLS // len(q))):
                    far = np.bitwise_count(q[:, None] ^ v[None, i : i + step].view(np.uint64))
                    bound = np.minimum(least, np.partition(far, k - 1, axis=1)[:, k - 1]) if far.shape[1] > k and not len(best[0]) else least
                    row, col = np.nonzero(far <= bound[:, None])
                    if not len(row):
                        continue
                    new = [np.concatenate(z) for z in zip(best, (row, far[row, col].astype(np.int64), first[i + col], v[i + col], n[i + col]), strict=True)]
                    order = np.lexsort((new[2], new[1], new[0]))
                    start = np.searchsorted(new[0][order], np.arange(len(q)))
                    best = tuple(z[order[np.arange(len(order)) - start[new[0][order]] < k]] for z in new)
                    end = np.searchsorted(best[0], np.arange(len(q)), "right")
                    full = end - np.searchsorted(best[0], np.arange(len(q))) == k
                    least[full] = best[1][end[full] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(q.view(np.int64)[best[0]]), *map(pa.array, (best[3], best[2], best[4])), pa.array(best[1].astype(np.int32))], names=["q", "v", "first", "n", "distance"])

        one = dealt.mapInArrow(work, "q long, v long, first long, n long, distance int")
        out = one if out is None else out.union(one)
    return out


def _learned(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors: a few rounds of the nearest and their means, from evenly spaced ones; an empty cell stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        at = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


class VectorCells:
    """A stored partition of a library (id, v) by nearest centroid: a folder of unit vectors for each cell, and each cell's centroid, radius and size.

    Centroids are learned from a sample of SAMPLE rows, which decides how much is skipped and not what is found: every
    row is in a cell, and a cell's radius is that of its rows. Vectors of a length that the sample lacks share a cell
    without a centroid, which is never skipped. Rows null or without a direction are left out: they have no score.
    """

    def __init__(self, snapshot: Snapshot) -> None:
        (part,) = snapshot.parts(NAME)
        self.sparkSession, self.rows = snapshot.spark, snapshot.load(part, _CELL, "/rows")
        self.centres = snapshot.load(part, _CENTRE, "/centres").toArrow().to_pylist()  # at most MOST_CELLS of each length, and one for each other

    @staticmethod
    def store(library: DataFrame, catalog: Catalog, most_cells: int = MOST_CELLS) -> VectorCells:
        spark, change = library.sparkSession, catalog.begin()
        rows = library.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
        many = rows.count()
        some = rows.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().combine_chunks()
        held, start = {}, 0
        for n, (_, x) in sorted((unit_vectors(some["v"].combine_chunks()) if some.num_rows else {}).items()):
            if len(x):
                wanted = int(min(most_cells, max(1, many * len(x) / some.num_rows / PER_CELL), np.sqrt(many) * 4))
                held[n] = start, _learned(x, wanted)
                start += len(held[n][1])
        known = spark.sparkContext.broadcast(held)  # MOST_CELLS vectors of a length
        schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("far", pa.float64())])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, (at, x) in unit_vectors(batch.column(1)).items():
                    if not len(at):
                        continue
                    cell, far = np.full(len(at), -n, np.int32), np.full(len(at), np.inf)
                    if n in known.value:
                        first, centres = known.value[n]
                        own = np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)
                        cell, far = (first + own).astype(np.int32), np.sqrt(((x - centres[own]) ** 2).sum(axis=1))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(at) + 1, n, dtype=np.int32)), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[at]), lists, pa.array(cell), pa.array(far)], schema=schema)

        dealt = settled(rows.where("id is not null").mapInArrow(work, "id long, v array<double>, cell int, far double"))
        name, folder = change.folder(NAME)
        dealt.select("id", "v", "cell").repartitionByRange("cell", "id").write.partitionBy("cell").parquet(f"{folder}/rows")
        place = {first + i: c.tolist() for first, centres in held.values() for i, c in enumerate(centres)}
        sizes = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.first(F.size("v")).alias("size")).collect()  # a row for each cell
        spark.createDataFrame([(r["cell"], place.get(r["cell"]), r["size"], r["radius"], r["n"]) for r in sizes], _CENTRE).coalesce(1).write.parquet(f"{folder}/centres")
        change.name(NAME, [{"folder": name, "kind": "cells"}])
        return VectorCells(change.commit())

    def nearest(self, queries: DataFrame, k: int) -> tuple[DataFrame, float]:
        """(query_id, id, score) that hold the k rows nearest by cosine to each query (query_id, q) but itself, and the share of the library's rows that were read for it.

        Each query first meets the cells around it that hold more than k rows. A cell whose centroid is farther than its
        radius and the k-th distance cannot hold a nearer row (the triangle inequality); the others are met then. Scores
        near the k-th are summed one by one, so that equal vectors tie wherever they lie.
        """
        asked = queries.select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
        blocks, out, read = max(1, -(-asked.count() // QUERIES)), None, 0
        total = sum(c["n"] for c in self.centres)
        for block in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
            ids = part["query_id"].to_numpy()
            seen: set[int] = set()
            for n, (at, q) in (unit_vectors(part["q"].combine_chunks()) if part.num_rows else {}).items():
                cells = [c for c in self.centres if c["size"] == n]
                if not cells or not len(at):
                    continue
                gap = np.stack([np.sqrt(((q - np.array(c["centroid"])) ** 2).sum(axis=1)) if c["centroid"] is not None else np.zeros(len(q)) for c in cells], axis=1)
                radius, size = np.array([c["radius"] for c in cells]), np.array([c["n"] for c in cells])
                order = np.argsort(gap, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros(gap.shape, bool)
                np.put_along_axis(first, order, before < k + 1, axis=1)
                one = settled(self._met(ids[at], q, [c["cell"] for c in cells], first, k))
                rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
                kth = one.select("query_id", "score", rank.alias("r")).where(F.col("r") <= k).where(F.col("r") == k).collect()  # a row for each query of the block
                least = {r["query_id"]: r["score"] for r in kth}
                far = np.array([np.sqrt(max(0.0, 2 - 2 * least[i])) if i in least else np.inf for i in ids[at].tolist()])
                more = ~first & (gap - radius - MARGIN <= far[:, None])
                both = one.union(self._met(ids[at], q, [c["cell"] for c in cells], more, k)) if more.any() else one
                out = both if out is None else out.union(both)
                seen |= {cells[j]["cell"] for j in np.flatnonzero((first | more).any(axis=0))}
            read += sum(c["n"] for c in self.centres if c["cell"] in seen)
        none = self.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double")
        return none if out is None else out, read / (total * blocks) if total else 0.0

    def _met(self, ids: np.ndarray, q: np.ndarray, cells: list[int], wanted: np.ndarray, k: int) -> DataFrame:
        """Of each task's rows of the cells that a query wants, the k nearest to it."""
        held = self.sparkSession.sparkContext.broadcast((ids, q, {cells[j]: np.flatnonzero(wanted[:, j]) for j in np.flatnonzero(wanted.any(axis=0))}))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, by = held.value
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, id, score
            for batch in batches:
                cell = batch.column(2).to_numpy()
                for c in np.unique(cell).tolist():
                    rows, who = np.flatnonzero(cell == c), by[c]
                    vectors = batch.column(1).take(pa.array(rows))
                    x = vectors.flatten().to_numpy().reshape(len(rows), -1)
                    names = batch.column(0).to_numpy()[rows]
                    step = max(k, CELLS // len(who))
                    for i in range(0, len(names), step):
                        score = np.where(ids[who][:, None] == names[None, i : i + step], -np.inf, q[who] @ x[i : i + step].T)
                        least = -np.partition(-score, k - 1, axis=1)[:, k - 1] - 1e-9 if score.shape[1] > k else np.full(len(who), -np.inf)
                        row, col = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                        exact = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[who[row[j : j + 65536]]], x[i + col[j : j + 65536]]) for j in range(0, len(row), 65536)]])
                        new = tuple(np.concatenate(z) for z in zip(best, (who[row], names[i + col], exact), strict=True))
                        order = np.lexsort((new[1], -new[2], new[0]))
                        start = np.searchsorted(new[0][order], np.arange(len(ids)))
                        kept = order[np.arange(len(order)) - start[new[0][order]] < k]
                        best = tuple(z[kept] for z in new)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2])], names=["query_id", "id", "score"])

        some = self.rows.where(F.col("cell").isin(*[c for j, c in enumerate(cells) if wanted[:, j].any()]))
        return some.select("id", "v", "cell").mapInArrow(work, "query_id long, id long, score double")


def palette_distance(a, b):
    """Mean distance of each colour to the nearest of the other palette, both ways, over the cube's diagonal."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    gap = lambda x, y: F.sqrt(sum(F.pow((x[c] - y[c]).cast("double"), F.lit(2.0)) for c in "rgb"))
    side = lambda p, q: F.aggregate(F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: gap(x, y)))), F.lit(0.0), lambda s, x: s + x) / F.size(p)
    return (side(a, b) + side(b, a)) / 2 / F.sqrt(F.lit(3 * 255.0**2))


def _shape(palette: str) -> list[Column]:
    """Of each channel of a palette the mean, least and greatest."""
    of = lambda c: F.transform(palette, lambda x: x[c].cast("double"))
    each = {"mean": lambda c: F.aggregate(of(c), F.lit(0.0), lambda s, x: s + x) / F.size(palette), "low": lambda c: F.array_min(of(c)), "high": lambda c: F.array_max(of(c))}
    return [f(c).alias(f"{name}_{c}") for name, f in each.items() for c in "rgb"]


def _gap(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Distances of boxes (n, 3) and boxes (m, 3); a point is a box."""
    apart = np.maximum(0, np.maximum(low[:, None] - high2[None], low2[None] - high[:, None]))
    return np.sqrt((apart * apart).sum(axis=2))


def _channels(palette: str) -> list[Column]:
    of = lambda c: F.transform(palette, lambda x: x[c].cast("double"))
    return [of(c).alias(c) for c in "rgb"]


def _colours(batch: pa.RecordBatch | pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of colours: the rows (r, g, b: a list each) that have so many, and their colours, one after the other."""
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column(x) for x in "rgb")]
    sizes = pc.list_value_length(columns[0]).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[n] = at, np.stack([c.take(pa.array(at)).flatten().to_numpy() for c in columns], axis=1)
    return out


def _palettes_met(queries: pa.Table, by: dict[int, np.ndarray], rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance): of each task's palettes (id, cell, r, g, b) the k nearest to each query (query_id, r, g, b) that wants their cell, and those within rounding of the k-th.

    Squares of distances of whole colours are exact in a product; sums go by a palette's order, as ``palette_distance`` adds.
    """
    held = rows.sparkSession.sparkContext.broadcast((queries, by))  # about QUERIES palettes

    def terms(x: np.ndarray, asked: bool) -> np.ndarray:
        square, one = (x * x).sum(axis=2, keepdims=True), np.ones((*x.shape[:2], 1))
        return np.concatenate([x, square, one] if asked else [-2 * x, one, square], axis=2)

    def side(least: list[np.ndarray]) -> np.ndarray:
        return reduce(np.add, map(np.sqrt, least)) / len(least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, by = held.value
        qid = queries["query_id"].to_numpy()
        asked = {m: (of, terms(q.reshape(len(of), m, 3), True)) for m, (of, q) in _colours(queries).items()}
        best, new = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []  # query, id, distance
        least = np.full(len(qid), np.inf)

        def kept() -> tuple[np.ndarray, ...]:
            every = [np.concatenate(z) for z in zip(best, *new, strict=True)]
            every = [z[order] for order in [np.lexsort((every[2], every[0]))] for z in every]
            start, end = (np.searchsorted(every[0], np.arange(len(qid)), x) for x in ("left", "right"))
            full = end - start >= k
            least[full] = every[2][start[full] + k - 1] + 2e-9  # distances are rounded, then ids decide
            return tuple(z[every[2] <= least[every[0]]] for z in every)

        for batch in batches:
            names, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for n, (at, x) in _colours(batch).items():
                x = terms(x.reshape(len(at), n, 3), False)
                for c in np.unique(cells[at]).tolist():
                    here = np.flatnonzero(cells[at] == c)
                    for m, (of, q) in asked.items():
                        mine = np.isin(of, by[c])
                        who = of[mine]
                        for i in range(0, len(here), step := max(1, CELLS // 16 // max(1, len(who)))) if len(who) else ():
                            some = here[i : i + step]
                            mine_least, its_least = ([np.full((len(who), len(some)), np.inf) for _ in range(z)] for z in (m, n))
                            for a in range(m):
                                for b in range(n):
                                    square = q[mine, a] @ x[some, b].T
                                    np.minimum(mine_least[a], square, out=mine_least[a])
                                    np.minimum(its_least[b], square, out=its_least[b])
                            far = (side(mine_least) + side(its_least)) / 2 / np.sqrt(3 * 255.0**2)
                            far[qid[who][:, None] == names[at[some]][None]] = np.inf
                            row, col = np.nonzero((far <= least[who][:, None]) & np.isfinite(far))
                            new.append((who[row], names[at[some]][col], far[row, col]))
                            if sum(len(z[0]) for z in new) > CELLS // 4:
                                best, new = kept(), []
        best = kept()
        yield pa.RecordBatch.from_arrays([pa.array(qid[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2])], names=["query_id", "id", "distance"])

    return rows.mapInArrow(work, "query_id long, id long, distance double")


def palette_neighbours(queries: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, rank of the k palettes (id, p) nearest to each query (query_id, q) but itself, by ``palette_distance`` to nine decimals, ties by id.

    The nearest colours of a palette average to a point within its box, so its mean distance to another is at least that
    from the mean to the other's box. Palettes lie on a grid by their mean; from the boxes of a cell's means and of its
    colours follows the least distance that a palette there can have, both ways. Each query meets the nearest cells
    that hold more than k, then those whose bound is within its k-th distance; a task's rows of a cell meet the queries that
    want it as products of matrices (``_palettes_met``). Rows are dealt to so many tasks that each compares about PALETTES
    pairs. Null and empty palettes are no one's neighbours.
    """
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(F.col(f"mean_{c}") * GRID / 256)))
    rows = library.where(F.size("p") > 0).select("id", "p", *_shape("p"))
    rows = settled(rows.withColumn("cell", ((cell("r") * GRID + cell("g")) * GRID + cell("b")).cast("int")))
    edge = [f(f"{x}_{c}").alias(f"{f.__name__}_{x}_{c}") for f, x in ((F.min, "mean"), (F.max, "mean"), (F.min, "low"), (F.max, "high")) for c in "rgb"]
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), *edge).orderBy("cell").toArrow()  # at most GRID ** 3
    asked = queries.where(F.size("q") > 0).select("query_id", "q").distinct()
    many = asked.count()
    blocks, out = max(1, -(-many // QUERIES)), None
    dealt = rows.select("id", "cell", *_channels("p")).repartition(int(max(1, -(-many * rows.count() // PALETTES))))
    box = lambda table, name: np.stack([table[f"{name}_{c}"].to_numpy() for c in "rgb"], axis=1)
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        q = some.select("query_id", *_shape("q")).toArrow()
        if not q.num_rows or not cells.num_rows:
            continue
        mean = box(q, "mean")
        bound = (_gap(mean, mean, box(cells, "min_low"), box(cells, "max_high")) + _gap(box(q, "low"), box(q, "high"), box(cells, "min_mean"), box(cells, "max_mean"))) / 2 / np.sqrt(3 * 255.0**2)
        ids, names, size = q["query_id"].to_numpy(), cells["cell"].to_numpy(), cells["n"].to_numpy()
        order = np.argsort(bound, axis=1, kind="stable")
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, np.cumsum(size[order], axis=1) - size[order] < k + 1, axis=1)

        held = some.select("query_id", *_channels("q")).toArrow().combine_chunks()
        at = {i: j for j, i in enumerate(held["query_id"].to_pylist())}

        def met(wanted: np.ndarray, held=held, at=np.array([at[i] for i in ids.tolist()]), names=names) -> DataFrame:
            by = {int(names[j]): at[np.flatnonzero(wanted[:, j])] for j in np.flatnonzero(wanted.any(axis=0))}
            near = _palettes_met(held, by, dealt.where(F.col("cell").isin(*by)), k)
            return _best(near.select("query_id", "id", F.round("distance", 9).alias("distance")), k)

        one = settled(met(first))
        kth = {r["query_id"]: r["distance"] for r in one.where(F.col("rank") == k).collect()}
        more = ~first & (bound <= np.array([kth.get(i, np.inf) for i in ids.tolist()])[:, None] + 1e-8)
        both = _best(one.drop("rank").unionByName(met(more).drop("rank")), k) if more.any() else one
        out = both if out is None else out.unionByName(both)
    return queries.sparkSession.createDataFrame([], "query_id bigint, id bigint, distance double, rank bigint") if out is None else out


def cosines(queries: DataFrame, library: DataFrame) -> DataFrame:
    """(query_id, id, score): the cosine of every query (query_id, q) of a stated set and every row of a library (id, v), null where one has no direction or another length.

    Queries are broadcast in blocks of QUERIES, and each batch of the library is one matrix product with a block.
    """
    sc, rows = library.sparkSession.sparkContext, library.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    asked = queries.select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
    blocks, out = max(1, -(-asked.count() // QUERIES)), None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        found = unit_vectors(part["q"].combine_chunks()) if part.num_rows else {}
        held = sc.broadcast((part["query_id"].to_numpy(), found))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, found = held.value
            for batch in batches if len(qid) else ():
                step = max(1, CELLS // 8 // len(qid))
                for i in range(0, batch.num_rows, step):
                    piece = batch.slice(i, step)
                    score = np.full((piece.num_rows, len(qid)), np.nan)
                    for n, (at, x) in unit_vectors(piece.column(1)).items():
                        if n in found:
                            score[np.ix_(at, found[n][0])] = x @ found[n][1].T
                    flat = score.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(qid, piece.num_rows)), pa.array(np.repeat(piece.column(0).to_numpy(), len(qid))), pa.array(flat, mask=np.isnan(flat))], names=["query_id", "id", "score"])

        one = rows.mapInArrow(work, "query_id long, id long, score double")
        out = one if out is None else out.union(one)
    return out


__all__ = ["VectorCells", "band_values", "cosines", "first_ids", "hash_neighbours", "palette_distance", "palette_neighbours"]
