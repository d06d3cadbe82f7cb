"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is 32 segments of two bits; its embedding is the vector of their bit counts. The Manhattan
distance of two embeddings is a lower bound of the Hamming distance. The grid: the 32 axes form ``GROUPS`` blocks;
two points within Manhattan distance r differ in at most r blocks, so they share the cell of at least one choice of
GROUPS - r blocks, and every choice is one key of an equi-join. Within a cell the Manhattan bound is checked first,
then the exact distance. A cell yields a spanning forest of its links (at most one edge a point), never all its
pairs; a cell of more than ``CELL`` points is split into blocks, so no task holds it, and only what its blocks do not
connect is compared further.
Equal fingerprints are one point, so copies add no work.

Null and empty texts have fingerprint zero and link like any other. Texts are taken whole. Rows that share a doc_id
are one point if their fingerprints agree. A null doc_id gets a fingerprint and the component of its group's other
rows (null if it has none). An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, chunks, cut, in_batches, lower, mixed, packed, run_hashes, runs, sized, table, without
from .common import _SPACE as SPACE
from .components import components

SHINGLE, RADIUS, GROUPS, CELL = 3, 3, 6, 4096
#: For copies whose sets of WORDS-word shingles have a Jaccard similarity of 0.8 or more: BANDS x ROWS min-hashes propose pairs, of two bits each at most UNLIKE may differ, and sets of at most MEMBERS documents are compared in a task's block.
WORDS, BANDS, ROWS, UNLIKE, MEMBERS = 5, 24, 4, 33, 1024
_LOW = 0x5555555555555555
_BYTES = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of 64-bit hashes; none: zero."""
    if not len(hashes):
        return 0
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((raw + _BYTES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel().astype(np.uint8)).tobytes(), "little")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash over XXH64 (seed 42) of the word shingles, A-Z in lower case; repeats count."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    a, b = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(line[i:j], 42) for i, j in zip(a, b, strict=True)), np.uint64, len(a)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint's 64 bits as a long, one row for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").transform(in_batches, work, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """Bit counts of the 32 segments, each written 00, 01 or 11: the Hamming distance of two is the Manhattan distance of the counts."""
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(F.lit(_LOW))
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseOR(low))


def _cells(groups: int, radius: int) -> list[int]:
    """A bit mask for every choice of groups - radius blocks of axes."""
    cuts = [round(32 * g / groups) for g in range(groups + 1)]
    blocks = [sum(3 << (2 * s) for s in range(cuts[g], cuts[g + 1])) for g in range(groups)]
    masks = [sum(x) for x in combinations(blocks, groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _thermometer(x: np.ndarray) -> np.ndarray:
    low = np.uint64(_LOW)
    a, b = (x >> np.uint64(1)) & low, x & low
    return ((a & b) << np.uint64(1)) | a | b


def _forest(points: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the rows of ``points``."""
    rest, edges, front = np.arange(len(points)), [], []
    while rest.size:
        if not front:
            front, rest = [int(rest[0])], rest[1:]
        at = front.pop()
        hit = linked(points[at], points[rest])
        new = rest[hit].tolist()
        rest = rest[~hit]
        edges += [(at, x) for x in new]
        front += new
    return edges


def _scan(columns: int, close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """Per partition, dealt and sorted by cell: the forest of each cell. Batches end where they will; a cell goes on in the next."""

    def cells(key: np.ndarray, points: np.ndarray, nodes: np.ndarray) -> tuple[list[int], list[int]]:
        a, b = [], []
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        pairs = first[sizes == 2]  # most cells: all at once
        ok = close(points[pairs], points[pairs + 1])
        a += nodes[pairs[ok]].tolist()
        b += nodes[pairs[ok] + 1].tolist()
        for i, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for x, y in _forest(points[i : i + n], close):
                a.append(int(nodes[i + x]))
                b.append(int(nodes[i + y]))
        return a, b

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                a, b = cells(rows[:, 0], rows[:, 2:].view(np.uint64), rows[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(columns + 2)], axis=1)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last:
                yield from out(np.concatenate([*kept, rows[:last]]))
                kept = []
            kept.append(rows[last:])
        if kept:
            yield from out(np.concatenate(kept))

    return work


def links(points: DataFrame, propose: int = 1, judge: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, radius: int = RADIUS, groups: int = GROUPS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect what the links among ``points`` connect.

    points: node (long) and fingerprints fp0, fp1, ... (long). Two link if one of the first ``propose`` fingerprints
    differs in at most ``radius`` bits and ``judge``, where given, accepts the two rows.
    """
    names = [c for c in points.columns if c.startswith("fp")]
    masks = _cells(groups, radius)
    keys = F.explode(F.array(*[F.xxhash64(F.lit(100 * i + k), embed(F.col(f"fp{i}")).bitwiseAND(F.lit(m))) for i in range(propose) for k, m in enumerate(masks)]))

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        one = lambda i: (np.bitwise_count(_thermometer(x[..., i]) ^ _thermometer(y[..., i])) <= radius) & (np.bitwise_count(x[..., i] ^ y[..., i]) <= radius)  # noqa: E731  the bound, then the distance
        near = one(0)
        for i in range(1, propose):
            near = near | one(i)
        return near & judge(x, y) if judge else near

    return _dealt(points.select(keys.alias("key"), "node", *names), _scan(len(names), close), cell)


def _scanned(keyed: DataFrame, scan: Callable) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "node").transform(in_batches, scan, "a long, b long")


def _dealt(keyed: DataFrame, scan: Callable, cell: int) -> DataFrame:
    """Edges (a, b) that connect what ``scan`` would link in the cells of ``keyed`` (key, node, what it reads).

    A cell beyond ``cell`` rows is scanned in blocks. What these connect already need not be compared again, so of such
    a cell only the nodes outside its largest part meet all others, in pairs of a block of them and a block of all: a
    large group of copies of one another is linked in proportion to its rows.
    """
    names = keyed.columns[2:]
    large = cut(keyed.groupBy("key").count().where(F.col("count") > cell).select("key", F.ceil(F.col("count") / cell).alias("blocks")))
    many = large.count()  # at most one cell in ``cell`` of the keyed rows
    if not many:
        return _scanned(keyed, scan)
    few = lambda cells: F.broadcast(cells) if many <= SMALL else cells  # noqa: E731  so that no cell's rows are brought together to learn its size
    dealt = lambda word, n: F.pmod(F.xxhash64(F.lit(word), "node"), F.col(n))
    blocked = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", dealt("block", "blocks"))).alias("key")
    roots = cut(components(_scanned(keyed.join(few(large), "key", "left").select(blocked, "node", *names), scan)))
    hot = keyed.select("key", "node").join(few(large), "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = hot.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rest = cut(hot.join(few(parts), "key").where("root <> main").select("key", "node", "blocks"))
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not rest.limit(1).count():
        return edges
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / cell).alias("others"), F.first("blocks").alias("blocks"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    every = keyed.select("key", "node").join(few(sizes), "key").select("key", "node", F.explode(F.transform(upto("others"), lambda i: F.struct(i.alias("i"), dealt("block", "blocks").alias("j")))).alias("at"))
    apart = rest.join(few(sizes.select("key", "others")), "key").select("key", "node", F.explode(F.transform(upto("blocks"), lambda j: F.struct(dealt("other", "others").alias("i"), j.alias("j")))).alias("at"))
    pairs = every.union(apart).distinct().select("key", "node", F.xxhash64("key", "at").alias("_cell"))
    again = pairs.join(keyed, ["key", "node"]).select(F.col("_cell").alias("key"), "node", *names)
    return edges.union(_scanned(again, scan))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, groups: int = GROUPS, cell: int = CELL) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id that links within ``radius`` bits reach."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"))
    roots = components(links(classes.select("node", F.col("fp").alias("fp0")), 1, None, radius, groups, cell))
    labels = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


_TIMES = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of chunks of whole texts, case and white space aside: first and end row, hashes and counts of the words, of the shingles (fewer than WORDS words: the whole sequence)."""
    data, offsets = packed(column)
    for i, j, part, bounds in chunks(data, offsets):
        part = lower(part)
        starts, ends = runs(~SPACE[part], bounds)
        words = run_hashes(part, starts, ends)[0]
        counts = np.diff(np.searchsorted(starts, bounds))
        size = np.repeat(np.minimum(counts, WORDS), counts)  # words of the shingle that starts here
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))
        hashes = np.zeros(len(words), np.uint64)
        for k in range(WORDS):
            more = np.flatnonzero((size > k) & (left >= size))
            hashes[more] = mixed(hashes[more] * np.uint64(3) + words[more + k])
        yield i, j, words, counts, hashes[left >= size], np.where(counts > 0, np.maximum(counts - WORDS + 1, 1), 0)


def _reduced(of: np.ufunc, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = of.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint, two hashes of the sequence of words (same0, same1), a key for every band, and two bits of every min-hash (fp0, fp1, ...)."""
    prints = [f"fp{i}" for i in range(BANDS * ROWS // 32)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, bands, bits = [], [], []
            for i, j, words, counts, hashes, sizes in _shingles(batch.column(1)):
                at = (np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
                same.append(np.stack([_reduced(np.add, mixed(words + mixed(at + np.uint64(z << 40))), counts) for z in (1, 2)]))
                keys, two = np.zeros((BANDS, j - i), np.uint64), np.zeros((len(prints), j - i), np.uint64)
                for k, times in enumerate(_TIMES):
                    least = mixed(_reduced(np.minimum, hashes * times, sizes))
                    keys[k // ROWS] = mixed(keys[k // ROWS] * np.uint64(3) + least + np.uint64(k))
                    two[k // 32] |= (least & np.uint64(3)) << np.uint64(2 * (k % 32))
                bands.append(keys)
                bits.append(two)
            wide = lambda parts, n: (np.concatenate(parts, axis=1) if parts else np.zeros((n, 0), np.uint64)).view(np.int64)
            flat = np.ascontiguousarray(wide(bands, BANDS).T).ravel()
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            simhash = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(simhash), *map(pa.array, wide(same, 2)), keys, *map(pa.array, wide(bits, len(prints)))], names=["doc_id", "simhash", "same0", "same1", "bands", *prints])

    return docs.select("doc_id", "text").transform(in_batches, work, "doc_id long, simhash long, same0 long, same1 long, bands array<long>, " + ", ".join(f"{x} long" for x in prints))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """key, node (as they are) and the sorted set of shingles of text, for every row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, hashes, sizes in _shingles(batch.column(2)):
                at = np.concatenate([[0], np.cumsum(sizes)])
                sets = [np.unique(hashes[a:b].view(np.int64)) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(sets, pa.list_(pa.int64()))], names=["key", "node", "shingles"])

    return docs.select("key", "node", "text").transform(in_batches, work, "key long, node long, shingles array<long>")


def alike(one: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the Jaccard similarity of a sorted set and each of several (concatenated) is 0.8 or more; whole numbers decide."""
    if not len(one):
        return sizes == 0
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.concatenate([[0], np.cumsum(one[at] == flat)])
    ends = np.cumsum(sizes)
    return 9 * (both[ends] - both[ends - sizes]) >= 4 * (len(one) + sizes)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition, dealt and sorted by key: a spanning forest of each key's sets that are ``alike``."""
    last, nodes, sets = None, [], []

    def edges() -> pa.RecordBatch:
        def linked(point: np.ndarray, rest: np.ndarray) -> np.ndarray:
            one, hit = sets[int(point)], np.zeros(len(rest), bool)
            size = np.array([len(sets[i]) for i in rest.tolist()], np.int64)
            able = np.flatnonzero(5 * np.minimum(size, len(one)) >= 4 * np.maximum(size, len(one)))
            if len(able):
                hit[able] = alike(one, np.concatenate([sets[i] for i in rest[able].tolist()]), size[able])
            return hit

        found = _forest(np.arange(len(sets)), linked)
        return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        flat, offsets = batch.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
        for i, (key, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != last:
                if len(sets) > 1:
                    yield edges()
                last, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(flat[offsets[i] : offsets[i + 1]])
    if len(sets) > 1:
        yield edges()


def near_copies(docs: DataFrame, cell: int = CELL, members: int = MEMBERS) -> DataFrame:
    """doc_id and group_id: what links of a Jaccard similarity of 0.8 or more between sets of five-word shingles connect.

    Pairs are proposed by the fingerprints of ``near_duplicates`` on their grid, and beside them by min-hash bands and bits
    for copies that a fingerprint tells further apart than ``RADIUS`` bits. Both only part the texts into groups that hold
    every link, but for about 4 in a million at exactly 0.8; within a group the sets themselves are compared. Texts of
    equal words are one point.
    """
    prints = cut(sketches(docs))
    names = [x for x in prints.columns if x.startswith("fp")]
    classes = cut(prints.where("doc_id is not null").groupBy("same0", "same1").agg(F.min("doc_id").alias("node"), *[F.first(x).alias(x) for x in ("simhash", "bands", *names)]))
    points = cut(classes.groupBy("simhash").agg(F.min("node").alias("point")))
    equal = classes.join(points, "simhash").where("node <> point").select(F.col("node").alias("a"), F.col("point").alias("b"))
    proposed = equal.union(links(points.select(F.col("point").alias("node"), F.col("simhash").alias("fp0")), cell=cell))
    low = np.uint64(_LOW)

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = x ^ y
        return np.bitwise_count((z | (z >> np.uint64(1))) & low).sum(axis=-1, dtype=np.int64) <= UNLIKE

    near = components(proposed.union(_dealt(classes.select(F.explode("bands").alias("key"), "node", *names), _scan(len(names), close), cell)))
    near = sized(near.select(F.col("root").alias("key"), "node"))
    sets = cut(shingle_sets(docs.select("doc_id", "text").join(near, F.col("doc_id") == F.col("node"))))  # read several times, made once
    roots = components(_dealt(sets, _compared, members))
    labels = classes.join(roots, "node", "left").select("same0", "same1", F.coalesce("root", "node").alias("group_id"))
    return prints.select("doc_id", "same0", "same1").join(labels, ["same0", "same1"]).select("doc_id", "group_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group of near copies: the smallest doc_id stays.

    Rows without a doc_id stay; rows that repeat a doc_id are one document and stay or go together.
    """
    return without(docs, near_copies(docs).where("doc_id <> group_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
