"""Hash and vector neighbours against brute force, and that they do not meet every row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import neighbours as V
from larder.operators import ranking as W
from larder.sources.catalog import Catalog


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_hashes(queries, library, k, most):
    out = []
    for q, a in queries:
        near = sorted(((a ^ v).bit_count(), i) for i, v in library if i != q)[:k]
        out += [(q, i, d, r) for r, (d, i) in enumerate(near, 1) if d <= most]
    return sorted(out)


@pytest.mark.parametrize(("kind", "k", "most"), [("clusters", 5, 32), ("copies", 7, 10), ("random", 3, 32), ("clusters", 60, 6)])
def test_hash_neighbours_against_brute_force(spark, kind, k, most):
    rng = random.Random(kind)
    if kind == "random":
        hashes = [rng.getrandbits(64) for _ in range(400)]
    else:
        seeds = [rng.getrandbits(64) for _ in range(12)]
        hashes = [rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), 0 if kind == "copies" and rng.random() < 0.7 else rng.randint(0, 9))) for _ in range(1500)]
    library = list(enumerate(hashes))
    queries = library[::37] + [(5000, rng.getrandbits(64))]
    lib = spark.createDataFrame([(i, signed(v)) for i, v in library] + [(9999, None)], "id long, v long")
    asked = spark.createDataFrame([(i, signed(v)) for i, v in queries] + [(7777, None)], "query_id long, q long")
    got = sorted(map(tuple, W.similar_by_hash(asked, lib, k, most).collect()))
    assert got == brute_hashes(queries, library, k, most)
    assert W.similar_by_hash(asked, lib.where("false"), k, most).count() == 0 == W.similar_by_hash(asked.where("false"), lib, k, most).count()


def test_hash_neighbours_have_no_nested_loop(spark):
    """Close hashes are decided by buckets: no scan, and no join without a key."""
    lib = spark.range(5000).select("id", F.col("id").bitwiseAND(F.lit(~7)).alias("v"))
    plans, plain = [], V.settled

    def noted(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return plain(rows)

    V.settled, scan = noted, V._scan
    V._scan = None
    try:
        found = W.similar_by_hash(lib.where("id % 500 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), lib, 6)
        assert found.count() == 60 and found.agg(F.max("distance")).first()[0] == 0
    finally:
        V.settled, V._scan = plain, scan
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)
    assert any("Join" in p for p in plans)


def test_hash_neighbours_do_not_grow_with_copies(spark, monkeypatch):
    """Rows and queries of one hash are met once; probes are used while they meet less than a scan; a scan is dealt to tasks by its pairs."""
    scanned, plain = [], V._scan

    def noted(queries, values, k):
        out = plain(queries, values, k)
        scanned.append((queries.count(), values.count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(V, "_scan", noted)
    monkeypatch.setattr(V, "SCAN", 1000)
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(90)]
    library = [(i, seeds[i % 90] if i % 3 else seeds[i % 7]) for i in range(2700)]
    lib = spark.createDataFrame([(i, signed(v)) for i, v in library], "id long, v long")
    asked = lib.where("id % 9 = 0 or id % 7 = 1").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    queries = [(i, v) for i, v in library if i % 9 == 0 or i % 7 == 1]
    for probe in (128, 1e-9):
        monkeypatch.setattr(V, "PROBE", probe)
        assert sorted(map(tuple, W.similar_by_hash(asked, lib, 8, 32).collect())) == brute_hashes(queries, library, 8, 32)
    different, many, tasks = scanned[0]
    assert different == len({v for _, v in queries}) < 100 and many == len({v for _, v in library}) and tasks == -(-different * many // 1000)


def brute_vectors(library, queries, k):
    unit = {i: v / n for i, v in library.items() if (n := np.linalg.norm(v)) > 0}
    out = []
    for q in queries:
        near = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in unit if i != q and len(unit[i]) == len(unit[q]))[:k]
        out += [(q, i, -s) for s, i in near]
    return sorted(out)


def test_vector_cells_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 24))
    library = {i: centres[i % 30] + 0.15 * rng.normal(size=24) for i in range(3000)}
    library |= {4000 + i: rng.normal(size=5) for i in range(20)} | {5000: np.zeros(24)} | {5001 + i: library[3] for i in range(8)}
    rows = [(i, v.tolist()) for i, v in library.items()] + [(6000, None), (6001, []), (6002, [float("nan")] * 24)]
    lib = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    index = V.VectorCells.store(lib, Catalog(spark, str(tmp_path / "a")))
    queries = [*range(0, 3000, 150), 4000, 5001]
    asked = lib.where(F.col("id").isin(*queries, 5000, 6000)).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near, share = index.nearest(asked, 12)
    got = sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in W.best(near, 12, [F.round("score", 9).desc(), F.asc("id")]).collect())
    assert got == brute_vectors(library, queries, 12)
    one, few = index.nearest(asked.where("query_id = 150"), 12)
    assert 0 < few < 0.1 and one.count() >= 12  # a query reads the cells around it
    assert few < share <= 1
    plan = index._met(np.array([1]), np.ones((1, 24)), [0, 1], np.array([[True, False]]), 3)._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert W.top_k(asked, index, 3, 0.99).where("score < 0.99").count() == 0
    none = V.VectorCells.store(lib.where("id > 90000"), Catalog(spark, str(tmp_path / "b")))
    assert none.nearest(asked, 3)[0].count() == 0


def test_cosines(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 2.0, 3.0])]
    lib = spark.createDataFrame(rows, "id long, v array<double>")
    asked = lib.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    want = {(a, b): None for a in range(1, 6) for b in range(1, 6)} | {(1, 1): 1.0, (2, 2): 1.0, (1, 2): 0.707107, (2, 1): 0.707107, (5, 5): 1.0}
    for block in (2048, 2):
        monkeypatch.setattr(V, "QUERIES", block)
        assert {(r["query_id"], r["id"]): r["score"] if r["score"] is None else round(r["score"], 6) for r in V.cosines(asked, lib).collect()} == want


def test_palette_neighbours_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    seeds = [[rng.randrange(256) for _ in range(3)] for _ in range(15)]
    near = lambda c: [max(0, min(255, x + rng.randint(-9, 9))) for x in c]
    rows = {i: [near(rng.choice(seeds[i % 15 : i % 15 + 2])) for _ in range(rng.randint(1, 6))] for i in range(500)} | {600 + i: [[7, 7, 7]] for i in range(9)}
    kind = "id long, p array<struct<r:smallint,g:smallint,b:smallint>>"
    lib = spark.createDataFrame([(i, [tuple(c) for c in p]) for i, p in rows.items()] + [(900, None), (901, [])], kind)
    asked = lib.where("id % 60 = 0 or id >= 608").select(F.col("id").alias("query_id"), F.col("p").alias("q"))

    def far(a, b):
        gap = lambda x, y: sum((m - n) ** 2 for m, n in zip(x, y, strict=True)) ** 0.5
        side = lambda p, q: sum(min(gap(x, y) for y in q) for x in p) / len(p)
        return round((side(a, b) + side(b, a)) / 2 / (3 * 255.0**2) ** 0.5, 9)

    for block in (2048, 4):
        monkeypatch.setattr(V, "QUERIES", block)
        found = V.palette_neighbours(asked, lib, 10)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((round(r["distance"], 8), r["id"]))
        want = {q: [(round(d, 8), i) for d, i in sorted((far(rows[q], p), i) for i, p in rows.items() if i != q)[:10]] for q in rows if q % 60 == 0 or q >= 608}
        assert got == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert V.palette_neighbours(asked.where("false"), lib, 3).count() == 0 == V.palette_neighbours(asked, lib.where("false"), 3).count()


def test_palettes_are_dealt_by_their_pairs(spark, monkeypatch):
    """Palettes that all lie in one cell meet in as many tasks as their pairs ask for, and no distance is computed in a join."""
    monkeypatch.setattr(V, "PALETTES", 4000)
    rng = random.Random(3)
    rows = [(i, [tuple(rng.randint(96, 127) for _ in range(3)) for _ in range(4)]) for i in range(400)]
    lib = spark.createDataFrame(rows, "id long, p array<struct<r:smallint,g:smallint,b:smallint>>")
    asked = lib.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("p").alias("q"))
    made, plain = [], V._palettes_met

    def noted(queries, by, rows, k):
        made.append((len(by), rows.rdd.getNumPartitions()))
        return plain(queries, by, rows, k)

    monkeypatch.setattr(V, "_palettes_met", noted)
    got = {(r["query_id"], r["id"], r["distance"]) for r in V.palette_neighbours(asked, lib, 7).collect()}
    assert made == [(1, 2)]
    far = asked.crossJoin(lib).where("query_id <> id").select("query_id", "id", F.round(V.palette_distance("q", "p"), 9).alias("distance"))
    assert got == {(r["query_id"], r["id"], r["distance"]) for r in V._best(far, 7).collect()}


def test_pair_percentiles_against_brute_force(spark, monkeypatch):
    """All pairs once, whatever the blocks; a vector is sent once for each block, and blocks grow before they become more."""
    from larder.operators import search as R

    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 6))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    lib = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    s = np.sort(np.rint(((x @ x.T)[np.triu_indices(700, 1)] + 1) / 1e-3).astype(int))
    want = {p: round(s[int(np.ceil(p * len(s))) - 1] * 1e-3 - 1, 9) for p in (0.01, 0.5, 0.99)}
    for block, parts, step, sent in ((16384, 8, 512, 2), (16384, 1, 64, 1), (100, 1, 64, 7)):
        for name, value in (("PAIR_BLOCK", block), ("PAIR_PARTS", parts), ("PAIR_STEP", step)):
            monkeypatch.setattr(R, name, value)
        found = R.pair_percentiles(lib)
        assert {r["percent"]: round(r["cosine"], 9) for r in found.collect()} == want
        assert f"sequence(0, {sent - 1}" in found._jdf.queryExecution().analyzed().toString()
