"""Invariants of sync, edits, names, streams and detectors, with near misses."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import features as D
from larder.operators import filters as P
from larder.operators import joins as J
from larder.operators import ranking as W
from larder.operators import search as R
from larder.operators import sets as U
from larder.operators import sync as I
from larder.operators import transfer as X
from larder.plans.standins import Tables
from larder.sources.catalog import Catalog
from larder.streaming.streams import ingest

from .oracle import SF


def stamp():
    return F.lit("2030-01-01").cast("timestamp_ntz")


def listing(spark, rows):
    return spark.createDataFrame([(p, h, 1, 10, None) for p, h in rows], "path string, content_hash string, root_id bigint, size bigint, mtime timestamp_ntz")


def assets(spark, rows):
    return spark.createDataFrame(rows, "id bigint, content_hash string")


def places(spark, rows):
    return spark.createDataFrame([(i, a, p, 1, 10, None, None, here) for i, (a, p, here) in enumerate(rows)], "id bigint, asset_id bigint, abs_path string, root_id bigint, size bigint, mtime timestamp_ntz, last_seen timestamp_ntz, present boolean")


def test_classify_each_status(spark):
    files = listing(spark, [("/new", "n"), ("/moved", "a"), ("/kept", "b"), ("/swapped", "a"), ("/rewritten", "never")])
    known = places(spark, [(1, "/old", True), (2, "/kept", True), (2, "/swapped", True), (2, "/rewritten", True)])
    got = {r["path"]: r["status"] for r in I.classify(files, assets(spark, [(1, "a"), (2, "b")]), known).collect()}
    assert got == {"/new": "added", "/moved": "relinked", "/kept": "unchanged", "/swapped": "updated", "/rewritten": "added"}


def test_sync_twice_changes_nothing(spark):
    files = listing(spark, [("/a", "x"), ("/b", "x"), ("/c", "y")])
    made = I.new_assets(files.withColumns({"kind": F.lit("image"), "title": F.col("path"), "mode": F.lit("managed")}), assets(spark, []).where("false"))
    rows = {r["content_hash"]: (r["id"], r["title"], r["managed"]) for r in made.collect()}
    assert rows == {"x": (0, "/a", True), "y": (1, "/c", True)}
    seen = I.classify(files, made, places(spark, []).where("false")).select(F.col("path").alias("abs_path"), "asset_id", "root_id", "size", "mtime")
    first = I.upsert_locations(places(spark, []).where("false"), seen, stamp())
    again = I.upsert_locations(first, seen, stamp())
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert I.needs_hash(files, first).count() == 0
    assert I.new_assets(files.withColumns({"kind": F.lit("image"), "title": F.col("path"), "mode": F.lit("x")}), made).count() == 0


def test_absent_only_under_scanned_roots(spark):
    old = places(spark, [(1, "/a", True), (2, "/b", True)]).withColumn("last_seen", F.lit("2020-01-01").cast("timestamp_ntz"))
    gone = I.mark_absent(old, stamp(), spark.createDataFrame([(1,)], "id bigint"))
    assert [r["present"] for r in gone.collect()] == [False, False]
    kept = I.mark_absent(old, stamp(), spark.createDataFrame([(9,)], "id bigint"))
    assert [r["present"] for r in kept.collect()] == [True, True]


def test_reprobe_keeps_manual_tags(spark):
    tags = spark.createDataFrame([(1, "a", "manual", None), (1, "b", "heuristic", 0.5), (2, "b", "heuristic", 0.5)], "asset_id bigint, name string, source string, confidence double")
    facts = spark.createDataFrame([(1, "w", None, 1.0)], "asset_id bigint, key string, value_text string, value_num double")
    new = spark.createDataFrame([(1, "c", "heuristic", 0.5), (1, "c", "heuristic", 0.5)], tags.schema)
    merged, values = I.reprobe(tags, facts, spark.createDataFrame([(1,)], "asset_id bigint"), facts.withColumn("value_num", F.lit(2.0)), new)
    assert sorted((r[0], r[1], r[2]) for r in merged.collect()) == [(1, "a", "manual"), (1, "c", "heuristic"), (2, "b", "heuristic")]
    assert values.first()["value_num"] == 2.0


def test_unknown_tag_source_raises(spark):
    t = Tables(spark, SF)
    bad = t.asset_tag.limit(1).withColumn("source", F.lit("guess"))
    with pytest.raises(Exception, match="unknown tag source"):
        U.add_tags(t.asset_tag, bad)[0].where("source = 'guess'").collect()


@pytest.mark.parametrize(("scheme", "want"), [
    ("export", ["a.png", "a-1.png", "a-01.png", "a-2.png", "a.png", "a-1.png"]),
    ("import", ["a.png", "a-1.png", "a-01.png", "a-2.png", "a.png", "a-1.png"]),
])
def test_names_meet_generated_ones(spark, scheme, want):
    rows = [("a.png", "1"), ("a-1.png", "2"), ("a-01.png", "3"), ("a.png", "4"), ("a.png", "1"), ("a-1.png", "2")]
    df = spark.createDataFrame([("f", n, h, i) for i, (n, h) in enumerate(rows)], "folder string, name string, content_hash string, ord bigint")
    assert [r["target"] for r in X.resolve_names(df, scheme).orderBy("ord").collect()] == want


def test_three_valued_negation(spark):
    t = Tables(spark, SF)
    with_null = t.asset.where("license is null").count()
    assert with_null > 0
    assert P.find(t, not_license="cc").where("license is null").count() == 0
    assert P.find(t, not_num=[("w", ">=", 512)]).where("kind = 'audio'").count() > 0


def test_filters_do_not_multiply(spark):
    t = Tables(spark, SF)
    assert P.find(t, tags=["good", "lang-en"]).count() == P.find(t, tags=["good", "lang-en"]).distinct().count()


def test_plans(spark):
    t = Tables(spark, SF)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan(P.find(t, tags=["good"]))
    assert "LeftAnti" in plan(P.find(t, not_tags=["good"]))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(t.asset.where("kind = 'image'").select("id"))
    assert "Python" not in plan(R.bm25(t.asset.select("id", "title", "notes"), ["the"], ("title", "notes")))


def test_many_queries_take_blocks(spark, monkeypatch):
    from larder.functions.numeric import hamming

    q = spark.range(9).select(F.col("id").alias("query_id"), F.col("id").alias("q"))
    lib = spark.range(20).select("id", F.col("id").alias("v"))
    want = sorted(map(tuple, J.score_all(q, lib, hamming).collect()))
    monkeypatch.setattr(J, "QUERIES", 2)
    assert sorted(map(tuple, J.score_all(q, lib, hamming).collect())) == want


def test_phrases_stay_in_a_field(spark):
    docs = spark.createDataFrame([(1, "red dragon", ""), (2, "red", "dragon"), (3, "dragon red", None)], "id bigint, title string, notes string")
    find = lambda *w: sorted(r[0] for r in R.match_all(docs, list(w), ("title", "notes")).collect())
    assert find("red dragon") == [1]
    assert find("red", "dragon") == [1, 2, 3]
    assert find("*") == []
    assert find("RED", "*") == [1, 2, 3]
    assert R.bm25(docs, ["red"], ("title", "notes")).count() == 3


def test_numbered_with_ties_and_nulls(spark, monkeypatch):
    rows = [(i, None if i % 50 == 0 else float(i % 7 == 0) if i % 3 else i / 10) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, score double").repartition(5)
    for up, most in ((True, 10), (False, 10), (True, 5000)):
        monkeypatch.setattr(W, "ONE_TASK", most)
        got = dict(map(tuple, R.ranked(df, up).collect()))
        want = sorted(rows, key=lambda r: (r[1] is None, (r[1] or 0) if up else -(r[1] or 0), r[0]))
        assert got == {i: k for k, (i, _) in enumerate(want, 1)}
    assert R.ranked(df.where("false")).count() == 0


def test_search_by_name(spark):
    t = Tables(spark, SF)
    docs = t.asset.select("id", "title", "notes")
    got = [r[0] for r in R.search(t, docs, ["the"], order_by="name").orderBy("rank").select("id").collect()]
    rows = {r["id"]: r["title"].lower() for r in t.asset.collect()}
    assert got == sorted(got, key=lambda i: (rows[i].encode(), i))


def test_ingest_of_snapshots(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    kind = "path string, content_hash string, kind string, title string, mode string, root_id bigint, size bigint, mtime timestamp_ntz"
    stamp = lambda day: F.lit(f"2030-01-0{day}").cast("timestamp_ntz")
    day = datetime(2020, 1, 1)

    def go(rows, n):
        return {r["path"]: r["status"] for r in ingest(catalog, spark.createDataFrame([(p, h, "image", p, "indexed", root, size, day) for p, h, root, size in rows], kind), stamp(n), spark.range(2)).collect()}

    assert go([("/a", "x", 0, 1), ("/b", "x", 0, 1), ("/c", "y", 1, 1), ("/far", "q", 7, 1)], 1) == dict.fromkeys(["/a", "/b", "/c", "/far"], "added")
    ids = {r["abs_path"]: r["id"] for r in catalog.location.collect()}
    assert sorted(ids.values()) == [0, 1, 2, 3] or sorted(ids.values()) == [1, 2, 3, 4]
    assert go([("/a", "x", 0, 1), ("/moved", "y", 1, 1), ("/b", "z", 0, 2)], 2) == {"/a": "unchanged", "/moved": "relinked", "/b": "added"}
    rows = {r["abs_path"]: r for r in catalog.location.collect()}
    assert {p: r["present"] for p, r in rows.items()} == {"/a": True, "/b": True, "/c": False, "/moved": True, "/far": True}
    assert all(rows[p]["id"] == ids[p] for p in ids)
    assert rows["/moved"]["asset_id"] == rows["/c"]["asset_id"]
    assert catalog.asset.count() == 4
    assert go([("/c", "y", 1, 1), ("/a", "x", 0, 1), ("/b", "x", 0, 3)], 3) == {"/c": "unchanged", "/a": "unchanged", "/b": "updated"}
    again = sorted(map(str, catalog.location.collect()))
    go([("/c", "y", 1, 1), ("/a", "x", 0, 1), ("/b", "x", 0, 3)], 3)
    assert sorted(map(str, catalog.location.collect())) == again
    assert catalog.asset.count() == 4


@pytest.mark.parametrize("queries", [2, 2048])
def test_nearest_against_brute_force(spark, queries, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(J, "QUERIES", queries)
    monkeypatch.setattr(J, "CELLS", 16)
    v = {i: rng.integers(-2, 3, 5).astype(float) for i in range(60)}  # many ties
    rows = [(i, x.tolist()) for i, x in v.items()] + [(100, None), (101, [1.0, 2.0]), (102, [0.0] * 5)]
    lib = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    asked = lib.where("id % 9 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = {}
    for r in W.top_k(asked, lib, 7, -2.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    unit = {i: x / np.linalg.norm(x) for i, x in v.items() if x.any()}
    for q in (i for i in unit if i % 9 == 0):
        want = sorted((-round(float(unit[q] @ x), 9), i) for i, x in unit.items() if i != q)[:7]
        assert got[q] == [(i, -s) for s, i in want]


def test_names_of_a_large_family(spark):
    """As many contents under one name as there are: in order, and in time that grows with them."""
    rows = [("f", "image.png", str(k % 5000), k) for k in range(10_000)]
    got = X.resolve_names(spark.createDataFrame(rows, "folder string, name string, content_hash string, ord bigint")).collect()
    assert {r["target"] for r in got if r["fresh"]} == {"image.png", *[f"image-{k}.png" for k in range(1, 5000)]}
    assert all(r["target"] == ("image.png" if int(r["content_hash"]) == 0 else f"image-{r['content_hash']}.png") for r in got)


@pytest.mark.parametrize("scheme", ["export", "import"])
def test_names_of_single_families_in_many_tasks(spark, scheme, monkeypatch):
    """Families of one name are numbered in range parts; the names are those of the rule applied in order."""
    monkeypatch.setattr(W, "ONE_TASK", 100)
    rng = random.Random(scheme)
    rows = []
    for name in ("image.png", "shot-7.jpg", "shot-007.gif", ".hidden", "none", "a.b-3.c", "x-99999999999999999999.y", "dots...", "n-٣.z"):
        rows += [(f"f{rng.randrange(2)}", name, rng.choice([None, *map(str, range(90))])) for _ in range(150)]
    rng.shuffle(rows)
    rows = [(*r, i) for i, r in enumerate(rows)]
    got = X.resolve_names(spark.createDataFrame(rows, "folder string, name string, content_hash string, ord bigint").repartition(7), scheme)
    want, names = [], {}
    for folder, name, digest, i in rows:
        held = names.setdefault((folder, name), X._Names(scheme))  # each name here is a family of its own
        want.append((folder, name, digest, i, *held.target(name, digest)))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == want
    parts = W.placed(spark.range(1000).select("id"), F.asc("id")).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 3


@pytest.mark.parametrize("scheme", ["export", "import"])
def test_names_against_one_by_one(scheme):
    rng = np.random.default_rng(0)
    for _ in range(200):
        names, taken, tried = X._Names(scheme), {}, {}
        for _ in range(40):
            name, digest = str(rng.choice(["a.x", "a-1.x", "a-2.x", "a-01.x", "a-1-1.x", "b", "b-3"])), str(rng.integers(0, 6))
            target = name
            if (name, digest) in tried:
                target = tried[name, digest]
            else:
                stem, dot, ext = name.rpartition(".")
                stem, ext = (stem, dot + ext) if stem else (name, "")
                k = 0
                while target in taken and taken[target] != digest:
                    k += 1
                    head, dash, tail = target.removesuffix(ext).rpartition("-")
                    target = f"{stem}-{k}{ext}" if scheme == "import" else f"{head}-{int(tail) + 1}{ext}" if dash and tail.isdecimal() else f"{target.removesuffix(ext)}-1{ext}"
            fresh = target not in taken
            assert names.target(name, digest) == (target, fresh)
            taken[target] = digest
            tried[name, digest] = target


def test_saved_searches_of_negated_terms_only(spark):
    t = Tables(spark, SF)
    terms = spark.createDataFrame([(1, "kind", "=", "image", True), (2, "tag", "=", "good", True), (2, "bytes", ">", "1kb", True)], "query_id bigint, field string, op string, value string, negated boolean")
    got = {(r["query_id"], r["id"]) for r in P.saved_searches(terms, t).select("query_id", "id").collect()}
    want = {(1, r["id"]) for r in P.find(t, not_kind="image").collect()} | {(2, r["id"]) for r in P.find(t, not_tags=["good"], not_num=[("bytes", ">", "1kb")]).collect()}
    assert got == want


def test_many_saved_searches_against_one_by_one(spark):
    """Thresholds that facts equal, unknown fields and values, several terms, plain and negated."""
    rng = random.Random(8)
    t = Tables(spark, SF)
    widths = sorted({int(r["value_num"]) for r in t.attribute.where("key = 'width'").collect()})
    terms = []
    for q in range(60):
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.2:
                term = ("kind", "=", rng.choice(["image", "audio", "nothing"]))
            elif kind < 0.4:
                term = ("tag", "=", rng.choice(["good", "Toxic", "lang-en", "never-used"]))
            else:
                value = rng.choice([str(rng.choice(widths)), str(rng.choice(widths) + 0.5), "1kb", "0", "999999", "wide"])
                term = (rng.choice(["width", "width", "bytes", "duration", "nope"]), rng.choice([">=", "<=", ">", "<", "="]), value)
            terms.append((q, *term, rng.random() < 0.3))
    got = {(r["query_id"], r["id"]) for r in P.saved_searches(spark.createDataFrame(terms, "query_id bigint, field string, op string, value string, negated boolean"), t).collect()}
    facts = {}
    for r in P.facts(t).collect():
        facts.setdefault(r["id"], []).append((r["field"], r["text"], r["number"]))
    unit = lambda v: 1024.0 if v == "1kb" else None if v == "wide" else float(v)
    compare = {">=": float.__ge__, "<=": float.__le__, ">": float.__gt__, "<": float.__lt__, "=": float.__eq__}

    def holds(item, field, op, value):
        if field in ("kind", "tag"):
            return any(f == field and x == value.lower() for f, x, _ in facts[item])
        return unit(value) is not None and any(f == field and compare[op](n, unit(value)) for f, _, n in facts[item])

    want = set()
    for q in range(60):
        mine = [x[1:] for x in terms if x[0] == q]
        want |= {(q, r["id"]) for r in t.asset.select("id").collect() if all(holds(r["id"], *x[:3]) != x[3] for x in mine)}
    assert got == want and 10 < len({q for q, _ in want})


def test_saved_searches_join_by_interval(spark):
    """A hundred thousand searches of one field: what meets a comparison is found by node and interval."""
    ids = spark.range(100_000)
    terms = ids.select(F.col("id").alias("query_id"), F.lit("width").alias("field"), F.lit(">=").alias("op"), (F.col("id") / 100.0 + 31.5).cast("string").alias("value"), F.lit(False).alias("negated"))
    both = terms.union(ids.select("id", F.lit("width"), F.lit("<"), (F.col("id") / 100.0 + 31.7).cast("string"), F.lit(False)))
    t = Tables(spark, SF)
    found = P.saved_searches(both, t)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    widths = [r["value_num"] for r in t.attribute.where("key = 'width'").collect()]
    want = sum(1 for w in widths for q in range(max(0, int(w * 100) - 3200), min(100_000, int(w * 100) - 3100)) if q / 100 + 31.5 <= w < q / 100 + 31.7)
    assert abs(found.count() - want) <= len(widths)  # a threshold may be rounded on either side


def test_credits_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "image", "a", "S", "L", "u"), (2, "image", "b", None, None, None), (3, "reference", "r2", None, None, None), (2, "reference", "r1", None, None, None)], "ord bigint, kind string, title string, source_name string, license string, source_url string")
    X.write_credits(X.credits(rows), str(tmp_path / "c"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "c").glob("part-*"))).split("\n")
    assert [x for x in lines if x] == ["## S", "Licence: L", "u", "- a", "## No source or licence recorded", "- b", "## References", "- r1", "- r2"]


def px(spark, arrays):
    rows = [(i, y, x, *map(int, a[y, x, :3]), int(a[y, x, 3]) if a.shape[2] == 4 else 255) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "asset_id bigint, y int, x int, r int, g int, b int, a int")


def test_upscaled_art_and_near_miss(spark):
    rng = np.random.default_rng(0)
    art = np.kron(rng.integers(0, 255, (24, 24, 3)), np.ones((4, 4, 1), int))
    organic = rng.integers(0, 255, (96, 96, 3))
    pixels = px(spark, [art, organic]).cache()
    blocks = D.period(D.boundary_signals(pixels), group="asset_id")
    assert dict(map(tuple, blocks.collect())) == {0: 4, 1: None}
    assert [(r["asset_id"], r["block_size"]) for r in D.upscale(pixels, blocks).collect()] == [(0, 4)]
    noisy = px(spark, [art + rng.integers(0, 60, art.shape)])
    assert D.upscale(noisy, spark.createDataFrame([(0, 4)], "asset_id bigint, period int")).count() == 0


def test_tileable_and_near_miss(spark):
    y, x = np.mgrid[0:32, 0:32]
    wave = lambda p: np.repeat((127 + 60 * np.sin(2 * np.pi * x / p) + 60 * np.cos(2 * np.pi * y / p)).astype(int)[:, :, None], 3, 2)
    framed = wave(8).copy()
    framed[0], framed[-1], framed[:, 0], framed[:, -1] = 50, 50, 50, 50
    assert [r["asset_id"] for r in D.tileable(px(spark, [wave(8), wave(13), framed])).collect()] == [0]


def test_normal_map_and_mask(spark):
    rng = np.random.default_rng(1)
    normal = np.stack([rng.integers(110, 146, (8, 8)), rng.integers(110, 146, (8, 8)), rng.integers(220, 256, (8, 8))], 2)
    sky = np.stack([np.full((8, 8), 90), np.full((8, 8), 160), np.full((8, 8), 250)], 2)
    assert [r["asset_id"] for r in D.normal_map(px(spark, [normal, sky])).collect()] == [0]
    two = np.repeat(rng.choice([0, 255], (8, 8))[:, :, None], 3, 2)
    photo = np.repeat(rng.integers(0, 255, (8, 8))[:, :, None], 3, 2)
    assert [r["asset_id"] for r in D.mask(px(spark, [two, photo])).collect()] == [0]


def test_pixels_are_never_the_side_that_is_held(spark, monkeypatch):
    """Made from a small table by explode, they look small to Spark; they came whole to the driver."""
    cells = spark.range(300).select(F.col("id").alias("asset_id"), F.explode(F.sequence(F.lit(0), F.lit(1023))).alias("k"))
    cells = cells.select("asset_id", F.floor(F.col("k") / 32).cast("int").alias("y"), (F.col("k") % 32).cast("int").alias("x"))
    grey = (F.floor(F.col("y") / 4) * 8 + F.floor(F.col("x") / 4)).cast("int")
    pixels = cells.select("asset_id", "y", "x", grey.alias("r"), grey.alias("g"), grey.alias("b"), F.when((F.col("x") % 16 == 15) | (F.col("y") % 16 == 15), 0).otherwise(255).alias("a"))
    for held, build in ((200_000, "BroadcastHashJoin"), (0, "ShuffledHashJoin")):
        monkeypatch.setattr(D, "HELD", held, raising=False)
        for found in (D.upscale(pixels, spark.range(300).select(F.col("id").alias("asset_id"), F.lit(4).alias("period"))), D.sprite_grid(pixels)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.splitlines() if "Join [" in line]
            assert len(joins) == 1 and build in joins[0] and "BuildRight" in joins[0], plan
            assert found.count() == 300


def test_sprite_grid_and_near_miss(spark):
    sheet = np.zeros((64, 96, 4), int)
    for r in range(2):
        for c in range(3):
            sheet[r * 32 + 2 : r * 32 + 28, c * 32 + 3 : c * 32 + 20 + 3 * c] = 255
    single = np.zeros((32, 32, 4), int)
    single[18:30, 4:28] = 255
    got = D.sprite_grid(px(spark, [sheet, single])).collect()
    assert [(r["asset_id"], r["cols"], r["rows"], r["frames"], r["confidence"]) for r in got] == [(0, 3, 2, 6, 0.8)]


def test_dhash_sign_bit(spark):
    grid = [(0, y, x, float(9 - x if y else x)) for y in range(8) for x in range(9)]
    got = D.dhash(spark.createDataFrame(grid, "asset_id bigint, y int, x int, value double")).first()["dhash"]
    assert got == -(1 << 63) + sum(1 << b for b in range(56, 63))


def test_flat_series_has_no_period(spark):
    rows = [("flat", i, 5.0) for i in range(60)] + [("beat", i, float(i % 6 == 0)) for i in range(120)] + [("short", i, float(i % 2)) for i in range(20)]
    got = dict(map(tuple, D.period(spark.createDataFrame(rows, "series_id string, i bigint, value double")).collect()))
    assert got == {"flat": None, "beat": 6, "short": None}


def test_title_cut_within_a_reference_keeps_it_as_written(spark):
    from larder.operators import links as L

    pages = spark.createDataFrame([("u", "<head><title>Of &lt;old&gt; caf&#233;s &amp;&amp;&amp</title></head>")], "url string, html string")
    assert L.html_head(pages).first()["head"]["title"] == "Of <old> cafés &&&amp"


def test_words_are_counted_within_their_document(spark):
    """No shuffle of words by document and token; documents of one id are put together."""
    from larder.operators import textindex as T
    from larder.sources.shared import settled

    docs = spark.createDataFrame([(1, "b a b", "a"), (2, None, ""), (3, "c", None)], "id bigint, title string, notes string")
    index = R.TextIndex(docs)
    rows = T.counted(settled(index.sorted_words()))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["id"], r["token"], r["n"], r["length"], list(r["places"])) for r in rows.collect())
    notes, title = 0, 1 << 32
    assert got == [(1, "a", 2, 4.0, [notes, title + 1]), (1, "b", 2, 4.0, [title, title + 2]), (3, "c", 1, 1.0, [title])]
    twice = T.counted(settled(R.TextIndex(docs.union(docs.where("id = 3"))).sorted_words())).where("id = 3").collect()
    assert [(r["n"], list(r["places"])) for r in twice] == [(2, [title, title])]


def test_tasks_that_write_an_index_do_not_grow(spark, tmp_path, monkeypatch):
    """Words are dealt to so many tasks that each sorts a like number, whatever the number of documents; a word that all documents hold is in several."""
    from larder.operators import textindex as T
    from larder.sources.catalog import Catalog

    monkeypatch.setattr(T, "PER_TASK", 1500)
    monkeypatch.setattr(T, "BLOCK", 8)
    docs = spark.range(600).select("id", F.concat(F.lit("common "), F.expr("array_join(transform(sequence(0, cast(id % 9 as int)), i -> concat('w', id * i)), ' ')")).alias("title"), F.when(F.col("id") != 7, F.lit("of")).alias("notes"))
    index = R.TextIndex(docs).store(Catalog(spark, str(tmp_path / "c")))
    rows = index.words(None).withColumn("file", F.input_file_name())
    assert max(r["count"] for r in rows.groupBy("file").count().collect()) <= 2 * T.PER_TASK
    assert rows.where("token = 'common'").select("file").distinct().count() > 1
    for name in ("posting", "lengths"):
        want, got = (sorted(map(tuple, x.select(sorted(x.columns)).collect())) for x in (getattr(R.TextIndex(docs), name), getattr(index, name)))
        assert want == got


def shuffled_records(spark, began):
    """Rows that were shuffled, by Spark's own metrics, since an execution; and the last execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, total = store.executionsList(), 0
    for k in range(runs.size()):
        run = runs.apply(k)
        if run.executionId() <= began:
            continue
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for m in range(metrics.size()):
                metric = metrics.apply(m)
                if metric.name() == "shuffle records written" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total, max((runs.apply(k).executionId() for k in range(runs.size())), default=-1)


def test_an_index_is_made_without_a_shuffle_of_its_words(spark, tmp_path):
    """Documents are dealt, not their words; words of several fields, marks, scripts and a document without words come back as they were."""
    from larder.operators import textindex as T
    from larder.sources.catalog import Catalog

    docs = spark.range(300).select("id", F.expr("array_join(transform(sequence(1, 60), i -> concat('Wört', (id * i) % 997)), ' - ')").alias("notes"), F.when(F.col("id") % 50 != 0, F.lit("Ÿes 東京 ١٢x 𐐀b_c")).alias("title"))
    docs = docs.withColumn("notes", F.when(F.col("id") != 100, F.col("notes")))
    _, began = shuffled_records(spark, -1)
    index = R.TextIndex(docs).store(Catalog(spark, str(tmp_path / "c")))
    sent, _ = shuffled_records(spark, began)
    assert 0 < sent < 300 * 10  # of over 18,000 words
    for name in ("posting", "lengths"):
        want, got = (sorted(map(tuple, x.select(sorted(x.columns)).collect())) for x in (getattr(R.TextIndex(docs), name), getattr(index, name)))
        assert want == got
    # a segment of other fields: places are numbered anew
    change = Catalog(spark, str(tmp_path / "c")).begin()
    T.add_segment(change, R.TextIndex(spark.createDataFrame([(1000, "ab cd", "ef")], "id long, caption string, title string")))
    both = T.Segments(change)
    rows, fields = both.renumbered()
    assert fields == ["caption", "notes", "title"]
    got = {(r["token"], r["n"], fields[r["places"][0] >> 32], r["places"][0] & 0xFFFFFFFF) for r in rows.where("id = 1000").collect()}
    assert got == {("ab", 1, "caption", 0), ("cd", 1, "caption", 1), ("ef", 1, "title", 0)}
    assert rows.where("id = 7 and token = 'c'").first()["places"] == [(2 << 32) + 4]
    assert {r["field"] for r in both.of_tokens(["ef", "c"]).collect()} == {"title"}


def test_blocks_of_an_index_are_full(spark, tmp_path, monkeypatch):
    """Documents of like length share a block, and a task leaves one block short at most, so that bounds are few."""
    from larder.operators import textindex as T
    from larder.sources.catalog import Catalog

    monkeypatch.setattr(T, "BLOCK", 64)
    docs = spark.range(300).select("id", F.expr("repeat('of ', cast(id as int))").alias("notes"))
    index = R.TextIndex(docs).store(Catalog(spark, str(tmp_path / "c")))
    blocks = index.docs.groupBy("block").agg(F.count("*").alias("n"), (F.max("length") - F.min("length")).alias("span")).collect()
    assert sorted(r["n"] for r in blocks) == [44, 64, 64, 64, 64] and max(r["span"] for r in blocks) == 63
    assert index.best(["of"], 3) == index.best(["of"], 300)[:3] and len(index.best(["of"], 300)) == 299
