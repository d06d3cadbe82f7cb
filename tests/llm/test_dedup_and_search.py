"""SimHash near-duplicates, exact top-k and components against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import simhash, topk
from larder.llm.components import components, least_beside

from ..oracle import SF, same


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark):
    docs = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    prints = {i: brute_print(t) for i, t in docs.items()}
    groups = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


@pytest.mark.parametrize("cell", [2, 5, 4096])
def test_links_in_dense_cells(spark, cell):
    """Clusters of fingerprints a few bits apart: split cells lose no link."""
    rng = random.Random(cell)
    prints = {}
    for c in range(4):
        base = rng.getrandbits(64)
        for k in range(40):
            flips = rng.sample(range(64), rng.choice([1, 2, 3, 6]))
            prints[c * 100 + k] = base ^ sum(1 << f for f in flips)
    points = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "node long, fp0 long").dropDuplicates(["fp0"])
    kept = {r["node"] for r in points.collect()}
    want = {i: r for i, r in brute_components({i: prints[i] for i in kept}).items()}
    roots = dict(map(tuple, components(simhash.links(points, cell=cell)).collect()))
    assert {i: roots.get(i, i) for i in kept} == want


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    for a, b in pairs:
        counts = [[(x >> (2 * s) & 1) + (x >> (2 * s + 1) & 1) for s in range(32)] for x in (a, b)]
        want = sum(abs(p - q) for p, q in zip(*counts, strict=True))
        x, y = simhash._thermometer(np.array([a], np.uint64)), simhash._thermometer(np.array([b], np.uint64))
        assert int(np.bitwise_count(x ^ y)[0]) == want <= (a ^ b).bit_count()
    df = spark.createDataFrame(pairs, "a long, b long").select(simhash.embed(F.col("a")).alias("e"), "a")
    assert all(int(simhash._thermometer(np.array([r["a"]], np.uint64))[0]) == r["e"] for r in df.collect())


def test_edges_of_tables(spark):
    kind = "doc_id long, text string, fp long, component_id long"
    rows = [(5, None, 1, 1), (3, "", 1, 1), (9, "Some WORDS here now", 1, 1), (7, "some words HERE now", 1, 1), (7, "some words here now", 1, 1), (None, "some words here now", 1, 1), (None, "alone and unlike any other text of them all", 1, 1)]
    got = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, kind)).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 7), (7, 7), (7, 7), (None, 7), (None, None)], key=str)
    empty = spark.createDataFrame([], kind)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0
    kept = simhash.deduplicated(spark.createDataFrame(rows, kind))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [3, 7, 7]
    assert kept.where("doc_id is null").count() == 2


def test_near_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    rows, copies = [], set()
    for g in range(30):
        base = [word() for _ in range(300)]
        rows.append((g * 10, " ".join(base)))
        for k in (1, 2):
            edited = list(base)
            for _ in range(2):
                edited[rng.randrange(300)] = word()
            rows.append((g * 10 + k, " ".join(edited)))
            copies.add(g * 10 + k)
        rows.append((g * 10 + 5, " ".join(word() for _ in range(300))))
        shuffled = list(base)
        rng.shuffle(shuffled)  # the same words in another order are no copy
        rows.append((g * 10 + 6, " ".join(shuffled)))
    kept = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {i for i, _ in rows} - kept
    assert gone <= copies
    assert len(gone) >= 0.9 * len(copies)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20] + [(1000, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for n in sorted(near):
        if n in seen:
            continue
        stack, group = [n], set()
        while stack:
            x = stack.pop()
            if x not in group:
                group.add(x)
                stack += near[x] - group
        seen |= group
        want |= {x: min(group) for x in group}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_chain(spark, monkeypatch):
    """Many rounds of joins: the sizes that Spark plans with stay those of the edges."""
    from larder.llm import components as module

    sizes, plain = [], module.written

    def noted(df, folder):
        out = plain(df, folder)
        sizes.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return out

    monkeypatch.setattr(module, "written", noted)
    ids = list(range(2000))
    random.Random(1).shuffle(ids)
    got = components(spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long"))
    assert [tuple(r) for r in got.groupBy("root").count().collect()] == [(0, 2000)]
    assert len(sizes) > 5 and max(sizes) < 1 << 20


def test_a_hub_is_split(spark):
    limits = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "256k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "512k", "adaptive.skewJoin.skewedPartitionFactor": "2", "adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(f"spark.sql.{k}", v)
        many = spark.range(1, 200_001, 1, 16).select(F.xxhash64("id").alias("y"))
        star = many.select(F.lit(0).cast("long").alias("x"), "y").union(many.select("y", "y"))
        parts = least_beside(star, "x", star).select("x", "y", "m", F.spark_partition_id().alias("part")).where("x = 0")
        rows = parts.groupBy("part").agg(F.count("*").alias("n"), F.max("y"), F.min("m").alias("m")).collect()
        assert sum(r["n"] for r in rows) == 200_000 and len({r["m"] for r in rows}) == 1
        assert max(r["n"] for r in rows) < 100_000
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_top_k_query(spark):
    assert same(topk.query(spark, SF), topk.ORACLE) > 0


@pytest.mark.parametrize(("nodes", "block"), [(1, 100), (4, 3), (7, 100)])
def test_top_k_against_brute_force(spark, nodes, block, monkeypatch):
    rng = np.random.default_rng(nodes)
    monkeypatch.setattr(topk, "CELLS", 64)
    data = {i: [float(x) for x in rng.integers(-3, 4, 6) / 4] for i in range(120)}  # many ties
    rows = [(i, v, 0) for i, v in data.items()] + [(1000, None, 0), (1001, [], 0), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1003, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (1100, [0.5, 0.25], 0)]
    df = topk.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3))
    asked = df.where("vec_id % 10 = 0")
    got = [tuple(r) for r in topk.top_k(df, asked, 5, nodes, block).orderBy("query_id", "rank").collect()]
    ints = {i: np.floor(1024 * np.array(v)).astype(int) for i, v in data.items()}
    want = []
    for q in (i for i in ints if i % 10 == 0):
        scored = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == want


def test_top_k_edges(spark):
    few = topk.vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (0, [0.2, 0.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk.top_k(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 204 * 512)]  # of repeated ids the least vector asks
    none = few.where("vec_id > 9")
    assert topk.top_k(none, none).count() == 0
    assert topk.top_k(few, none).count() == 0
    large = topk.vectors(spark.createDataFrame([(0, [2.0e5, 1.0]), (1, [2.0e5, 3.0]), (2, [2.0e5, -7.0]), (3, [2.0e5, 3.0])], "vec_id long, embedding array<double>"))
    assert [r["vec_id"] for r in topk.top_k(large, large.where("vec_id = 0"), 2).orderBy("rank").collect()] == [1, 3]
    big = spark.createDataFrame([(0, [1e16])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.vectors(big).collect()


def test_top_k_of_large_components(spark):
    """Products beyond 64 bits that cancel give exact scores; a score beyond 64 bits raises."""
    rng = np.random.default_rng(3)
    data = {i: [4e6, 4e6, float(rng.integers(-9, 9))] if i == 0 else [a := 4e6 + float(rng.integers(-900, 900)), -a + float(rng.integers(-9, 9)) / 8, float(rng.integers(-9, 9))] for i in range(60)}
    rows = topk.vectors(spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>").repartition(3))
    ints = {i: [int(1024 * x) for x in v] for i, v in data.items()}
    want = sorted((-sum(a * b for a, b in zip(ints[0], v, strict=True)), i) for i, v in ints.items() if i)[:7]
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(rows, rows.where("vec_id = 0"), 7).orderBy("rank").collect()] == [(i, -s) for s, i in want]
    over = topk.vectors(spark.createDataFrame([(0, [4e6]), (1, [4e6])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="no 64-bit number"):
        topk.top_k(over, over.where("vec_id = 0")).collect()


@pytest.mark.parametrize("nodes", [1, 2, 5])
def test_top_k_phases(nodes):
    """The cutoff is safe, what is collected holds all that reach it and far less than all pairs, and scores are exact."""
    rng = np.random.default_rng(nodes)
    x = rng.normal(0, 100, (4000, 64)).astype(np.int64)
    q = x[:20]
    parts = [q[:, s].astype(float) @ x[:, s].T.astype(float) for s in topk._axes(64, nodes)]
    own = np.arange(4000)[None, :] == np.arange(20)[:, None]
    truth = np.where(own, np.iinfo(np.int64).min, q @ x.T)
    sums = np.sort(topk.listed(parts, own, 10), axis=1)[:, ::-1]
    assert all(set(a[np.isfinite(a)]) <= set(b.astype(float)) for a, b in zip(sums, truth, strict=True))
    least, margin = sums[:, 9], np.full((20, 4000), 1e-3)
    assert (least <= np.sort(truth, axis=1)[:, -10]).all()
    at, col, total, sent = topk.sufficient(parts, own, least, margin)
    assert {(a, b) for a, b in zip(*np.nonzero(truth >= least[:, None]), strict=True)} <= set(zip(at, col, strict=True))
    assert len(at) < 20 * 4000 * (0.01, 0.12, 0.6)[(1, 2, 5).index(nodes)]
    at, col, score = topk.resolved(q, x, parts, (at, col, total, sent), least, margin)
    assert (score == truth[at, col]).all()
    assert len(at) == (truth >= least[:, None]).sum()


@pytest.mark.parametrize("members", [3, 1024])
def test_near_copies_by_kind_of_edit(spark, members):
    """Every pair at a Jaccard similarity of 0.8 or more is found, whatever was edited, and none below."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    replaced = lambda base, share: [word() if rng.random() < share else x for x in base]
    kinds = {
        "replaced 2 %": lambda base: replaced(base, 0.018),
        "replaced 5 %": lambda base: replaced(base, 0.05),
        "appended 5 %": lambda base: base + [word() for _ in range(len(base) // 20)],
        "appended 10 %": lambda base: base + [word() for _ in range(len(base) // 10)],
        "appended 20 %": lambda base: base + [word() for _ in range(len(base) // 5)],
        "appended 40 %": lambda base: base + [word() for _ in range(2 * len(base) // 5)],
        "prepended 10 %": lambda base: [word() for _ in range(len(base) // 10)] + base,
        "cut 15 %": lambda base: base[: len(base) * 85 // 100],
    }
    shingled = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    rows, want, seen = [], set(), 0
    for kind in kinds.values():
        for _ in range(25):
            base = [word() for _ in range(rng.choice([60, 300, 800]))]
            copy = kind(base)
            a, b = shingled(base), shingled(copy)
            rows += [(2 * seen, " ".join(base)), (2 * seen + 1, " ".join(copy).upper())]
            if len(a & b) * 5 >= len(a | b) * 4:
                want.add(2 * seen + 1)
            seen += 1
    assert 100 < len(want) < 180
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in simhash.near_copies(docs, members=members).where("doc_id <> group_id").collect()}
    assert found == want


def test_near_copies_of_one_large_group(spark):
    """A chain whose ends are unlike is one group, also when its documents are compared in blocks."""
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 300])) for i in range(40)] + [(90, ""), (91, None), (92, "one two"), (93, "One  two"), (94, "two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, simhash.near_copies(docs, cell=5, members=4).collect()))
    assert got == {**dict.fromkeys(range(40), 0), 90: 90, 91: 90, 92: 92, 93: 92, 94: 94}


def test_near_copies_by_fingerprint_alone(spark, monkeypatch):
    """The grid of fingerprints proposes pairs by itself; far texts are not linked by it."""
    monkeypatch.setattr(simhash, "UNLIKE", -1)  # min-hashes propose nothing
    rng, rows = random.Random(5), []
    for i in range(20):
        words = [f"w{rng.randrange(4000)}" for _ in range(1500)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:700], f"x{i}", *words[701:]]))]
    prints = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    near = {2 * i + 1 for i in range(20) if (prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= simhash.RADIUS}
    assert len(near) >= 10
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id <> group_id")
    assert {r["doc_id"] for r in found.collect()} == near
