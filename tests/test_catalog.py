"""Versions of all tables, the segmented text index, and searches that skip blocks."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larder.operators import search as R
from larder.operators import textindex as X
from larder.operators.aggregates import text_docs
from larder.plans.standins import Tables
from larder.sources.catalog import SCHEMAS, Catalog, ConcurrentWrite
from larder.streaming.streams import ingest

from .oracle import SF


def tags(spark, *rows):
    return spark.createDataFrame([(i, n, None) for i, n in rows], SCHEMAS["tag"])


def named(snapshot):
    return sorted((r["id"], r["name"]) for r in snapshot.tag.collect())


def test_versions_of_one_table(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    assert catalog.read("tag").count() == 0 and catalog.snapshot().number == 0
    catalog.write("tag", tags(spark, (1, "a")))
    catalog.write("tag", catalog.tag.union(tags(spark, (2, "b"))))
    assert named(catalog) == [(1, "a"), (2, "b")]
    began = catalog.snapshot()
    catalog.append("tag", tags(spark, (2, "c"), (3, "d")), began)
    with pytest.raises(ConcurrentWrite, match="tag"):
        catalog.write("tag", tags(spark), began)
    assert named(catalog) == [(1, "a"), (2, "c"), (3, "d")]
    for k in range(5):
        catalog.append("tag", tags(spark, (k, f"n{k}")), most=3)
    assert named(catalog) == [(k, f"n{k}") for k in range(5)]
    change = catalog.begin()
    change.remove("tag", tags(spark, (1, ""), (9, "")))
    change.put("tag", tags(spark, (3, "again")))
    assert named(change) == [(0, "n0"), (2, "n2"), (3, "again"), (4, "n4")] and len(named(catalog)) == 5
    change.commit()
    assert named(catalog) == named(change.now())
    assert named(catalog.snapshot(2)) == [(1, "a"), (2, "b")]  # an older version reads as it was
    assert named(began) == [(1, "a"), (2, "b")]
    with pytest.raises(FileNotFoundError):
        catalog.snapshot(99)
    assert catalog.expire(1) > 3 and len(catalog.numbers()) == 1 and named(catalog) == [(0, "n0"), (2, "n2"), (3, "again"), (4, "n4")]


def test_one_commit_for_several_tables(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path))
    one = catalog.begin()
    one.write("tag", tags(spark, (1, "a")))
    one.write("collection", spark.createDataFrame([(1, "set", None, None)], SCHEMAS["collection"]))
    assert catalog.snapshot().number == 0  # nothing is seen before the commit
    one.commit()
    # a writer that stops between any two steps leaves the version that was there
    two = catalog.begin()
    two.write("tag", tags(spark, (2, "b")))
    two.write("collection", spark.createDataFrame([(2, "other", None, None)], SCHEMAS["collection"]))
    monkeypatch.setattr(Catalog, "publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        two.commit()
    monkeypatch.undo()
    open(tmp_path / "versions" / "_half-written", "w").write("{")
    assert catalog.numbers() == [1] and named(catalog) == [(1, "a")] and catalog.collection.first()["name"] == "set"
    # of two writers to a table one fails; writers to different tables both win
    a, b, c = catalog.begin(), catalog.begin(), catalog.begin()
    a.put("tag", tags(spark, (3, "c")))
    b.put("tag", tags(spark, (4, "d")))
    c.put("collection", spark.createDataFrame([(3, "third", None, None)], SCHEMAS["collection"]))
    a.commit()
    with pytest.raises(ConcurrentWrite, match="tag"):
        b.commit()
    assert c.commit().number == 3
    assert named(catalog) == [(1, "a"), (3, "c")] and catalog.collection.count() == 2
    # what was only read counts too
    d = catalog.begin()
    d.put("root", d.tag.select("id", F.col("name").alias("path")))
    catalog.append("tag", tags(spark, (5, "e")))
    with pytest.raises(ConcurrentWrite, match="tag"):
        d.commit()


def texts(rng, n, start=0):
    words = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["of"] * 10
    return {start + i: " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20, 80]))) + (" the of" if i % 3 else "") for i in range(n)}


def frame(spark, held):
    return spark.createDataFrame([(i, t, "Ferry" if i % 4 == 0 else "") for i, t in held.items()], "id long, notes string, title string")


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def same_index(spark, index, held):
    """The stored index says what one made anew does."""
    new = X.TextIndex(frame(spark, held))
    row = lambda r: (r["id"], r["field"], r["pos"], r["token"])
    assert sorted(map(row, index.posting.collect())) == sorted(map(row, new.posting.collect()))
    assert index.size() == pytest.approx(tuple(new.totals().first()))
    for words in (["the"], ["of the", "w3"], ["missing"]):
        assert scores(R.bm25(index, words)) == scores(R.bm25(new, words))
    for words, k in ((["the", "of"], 7), (["w1", "w2"], 50), (["w5", "the", "the"], 1), (["ferry"], 1000), (["the of"], 4), (["missing"], 5)):
        want = sorted((s, i) for i, s in scores(R.bm25(new, words)).items())[:k]
        got = [(round(r["score"], 9), r["id"]) for r in R.best_matches(index, words, k).orderBy("rank").collect()]
        assert [s for s, _ in got] == [s for s, _ in want]
        assert {x for x in got if not want or x[0] < want[-1][0]} == {x for x in want if x[0] < want[-1][0]}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_index_segments_follow_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    rng, catalog = random.Random(4), Catalog(spark, str(tmp_path))
    held = texts(rng, 600)
    X.TextIndex(frame(spark, held)).store(catalog)
    whole = size(tmp_path)
    for step in range(5):
        new = texts(rng, 12, 1000 + 20 * step) | {i: "the changed w3 of the " + held[i] for i in rng.sample(sorted(held), 8)}
        gone = set(rng.sample(sorted(set(held) - set(new)), 6)) | {99_999}
        held = {i: t for i, t in held.items() if i not in gone} | new
        before = size(tmp_path)
        change = catalog.begin()
        X.reindex(change, frame(spark, new), spark.createDataFrame([(i,) for i in [*new, *gone]], "id long"))
        if step < 2:
            same = X.Segments(catalog.snapshot()).size()
            assert same != X.Segments(change).size()  # not seen before the commit
        snapshot = change.commit()
        if step in (2, 4):
            same_index(spark, X.Segments(snapshot), held)
        assert size(tmp_path) - before < whole / 2  # what is written follows the batch
    numbers = [p["docs"] for p in snapshot.parts(X.NAME) if p["kind"] == "segment"]
    assert 600 in numbers and len(numbers) < 6 and max(n for n in numbers if n != 600) > 20  # small ones were merged
    change = catalog.begin()
    X.forget(change, spark.createDataFrame([(i,) for i in held], "id long"))
    empty = X.Segments(change.commit())
    assert empty.size() == (0, 0.0) and empty.best(["the"], 5) == [] and R.bm25(empty, ["the"]).count() == 0


def test_merge_drops_what_is_gone(spark, tmp_path):
    rng, catalog = random.Random(6), Catalog(spark, str(tmp_path))
    held = {}
    for k in range(4):
        new = texts(rng, 20, 10 * k)  # half of them change the batch before
        held |= new
        change = catalog.begin()
        X.reindex(change, frame(spark, new), spark.createDataFrame([(i,) for i in new], "id long"))
        change.commit()
    parts = catalog.snapshot().parts(X.NAME)
    assert [p["kind"] for p in parts] == ["segment"] and parts[0]["docs"] == len(held) == 50
    same_index(spark, X.Segments(catalog.snapshot()), held)


def scanned_rows(spark, began):
    """Rows that scans of words have given, by Spark's own metrics, since an execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, total = store.executionsList(), 0
    for k in range(runs.size()):
        run = runs.apply(k)
        if run.executionId() <= began:
            continue
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if "Scan parquet" in node.name() and "token#" in node.desc() and "id#" in node.desc():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total, max((runs.apply(k).executionId() for k in range(runs.size())), default=-1)


def test_best_matches_read_few_postings(spark, tmp_path, monkeypatch):
    """The exact best of a common word, from a share of its postings."""
    monkeypatch.setattr(X, "BLOCK", 64)
    monkeypatch.setattr(X, "PAGE", 100)
    rows = spark.range(20_000).select("id", F.concat(F.repeat(F.lit("the "), (1 + F.pmod(F.xxhash64("id"), F.lit(4))).cast("int")), F.repeat(F.lit("x "), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60))).cast("int"))).alias("notes"))
    index = X.TextIndex(rows).store(Catalog(spark, str(tmp_path)))
    _, began = scanned_rows(spark, -1)
    top = index.best(["the"], 20)
    read, began = scanned_rows(spark, began)
    every = R.bm25(index, ["the"]).orderBy("score", "id").limit(20).collect()
    assert [(round(s, 9), i) for s, i in top] == [(round(-r["score"], 9), r["id"]) for r in every]
    full, _ = scanned_rows(spark, began)
    assert 0 < read < 20_000 / 4 and full >= 20_000
    few = index.best(["the"], 20, within=spark.range(0, 20_000, 97))
    assert len(few) == 20 and all(i % 97 == 0 for _, i in few)
    assert R.best_matches(index, ["the"], 3).count() == 3


def test_stored_index_reads_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PER_BUCKET", 20)
    docs = text_docs(Tables(spark, SF))
    index = R.TextIndex.of(docs).store(Catalog(spark, str(tmp_path)), 8)
    for words in (["the"], ["of the", "onon"], ["ferryBell"], ["*"]):
        assert scores(R.bm25(index, words)) == scores(R.bm25(docs, words))
    plan = index.of_tokens(["onon"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "token" in plan.split("PushedFilters")[1]
    assert "places" not in index.hits([["the"]])._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]


def test_search_follows_ingest(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    kind = "path string, content_hash string, kind string, title string, mode string, root_id bigint, size bigint, mtime timestamp_ntz"

    def go(n, *rows):
        at = F.lit(f"2030-01-0{n}").cast("timestamp_ntz")
        return ingest(catalog, spark.createDataFrame([(p, h, "image", p, "indexed", 0, s, datetime(2020, 1, 1)) for p, h, s in rows], kind), at, spark.range(2))

    found = lambda *words: sorted(r["id"] for r in R.match_all(X.Segments(catalog.snapshot()), list(words)).collect())
    go(1, ("/a/harbour.png", "x", 1), ("/a/quay.png", "y", 1))
    number = catalog.snapshot().number
    assert number == 1 and len(found("png")) == 2 and len(found("harbour")) == 1
    go(2, ("/a/harbour.png", "z", 2), ("/a/quay.png", "y", 1), ("/b/lamp.png", "x", 1))  # new content at a known path; the old one elsewhere
    assert len(found("png")) == 3 and len(found("lamp")) == 1 and len(found("harbour")) == 2
    fresh = X.TextIndex(text_docs(catalog))
    key = lambda r: (r["id"], r["field"], r["pos"], r["token"])
    assert sorted(map(key, X.Segments(catalog.snapshot()).posting.collect())) == sorted(map(key, fresh.posting.collect()))
    go(3, ("/a/harbour.png", "z", 2), ("/a/quay.png", "y", 1), ("/b/lamp.png", "x", 1))
    assert sorted(map(key, X.Segments(catalog.snapshot()).posting.collect())) == sorted(map(key, fresh.posting.collect()))
