"""What the training-data operators share: table access, lineage cuts, packed text and numpy helpers."""

from __future__ import annotations

import ctypes
import tempfile
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that a numpy pass takes at once; a longer document is a pass of its own.
CHUNK = 1 << 19
#: Bytes of texts that go to a Python worker at once, unless the session asks for another number than Spark's own.
ARROW_BATCH, ARROW_KEY, ARROW_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64MB")
#: Ids that may be broadcast, 8 bytes each.
SMALL = 1_000_000
#: Bytes of a run up to which all runs are hashed side by side.
LONG = 64
_BASE = np.uint64(0x100000001B3)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one on a single machine, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-larder-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one; the file system removes it when the application ends."""
    folder = f"{shared_dir(spark)}/{kind}-{uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def written(df: DataFrame, folder: str) -> DataFrame:
    """Rows written as Parquet and read back. Unlike a checkpoint's, the sizes that Spark then plans with are those of
    the files: in a loop of joins a checkpointed plan's estimates multiply each round until planning alone takes minutes."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, so that a lost executor costs no recomputation."""
    return written(df, f"{shared_folder(df.sparkSession, 'cut')}/rows")


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of bounded bytes; a worker gives its free memory back when its partition is done."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_KEY, ARROW_DEFAULT[0]) in ARROW_DEFAULT:
        conf.set(ARROW_KEY, ARROW_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that this process has freed to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and the offsets of its rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@lru_cache(1)
def _categories() -> np.ndarray:
    """For every code point of the first four planes: 2 a letter, 1 a mark, 0 anything else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(1 << 18)], np.int8)


def letters(data: np.ndarray) -> np.ndarray:
    """For every byte of UTF-8 text: 2 within a letter, 1 within a combining mark, 0 elsewhere."""
    kinds = _categories()
    out = np.zeros(len(data), np.int8)
    ascii_ = data < 128
    out[ascii_] = kinds[data[ascii_]]
    for lead, bits, size in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
        at = np.flatnonzero((data & np.uint8(0xFF ^ bits)) == lead)
        at = at[at + size <= len(data)]
        if at.size:
            code = (data[at] & np.uint8(bits)).astype(np.int64)
            for k in range(1, size):
                code = (code << 6) | (data[at + k] & np.uint8(0x3F))
            kind = kinds[np.minimum(code, len(kinds) - 1)]
            for k in range(size):
                out[at + k] = kind
    return out


def parts(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """As ``chunks``, and whether the row ends here: a row of over ``limit`` bytes comes in parts, cut after an ASCII byte that is no letter or, without one, between characters."""
    for i, j, part, bounds in chunks(data, offsets, limit):
        while len(part) > limit and j == i + 1:
            head = part[:limit]
            gaps = np.flatnonzero(~_LETTER[head[1:]]) + 1 if not _LETTER[head[1:]].all() else np.flatnonzero((head[1:] & 0xC0) != 0x80)
            at = int(gaps[-1]) + 1 if len(gaps) else limit
            yield i, j, part[:at], np.array([0, at]), False
            part = part[at:]
            bounds = np.array([0, len(part)])
        yield i, j, part, bounds, True


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters (as UTF-8 bytes) in lower case."""
    out = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[high] += 32
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends with its row."""
    if not mask.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(mask), bool)
    first[0] = True
    np.logical_not(mask[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < len(mask)]] = True
    first &= mask
    last = np.empty(len(mask), bool)
    last[-1] = True
    np.logical_not(mask[1:], out=last[:-1])
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    last &= mask
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """A 64-bit hash of the bytes of every run, then of its first p bytes for every p in prefixes (0 if it is no longer)."""
    h, size = np.zeros(len(starts), np.uint64), ends - starts
    heads = {p: np.zeros(len(starts), np.uint64) for p in prefixes}
    live, at, k = np.arange(len(starts)), starts, 0
    acc = h.copy()
    while live.size and k < LONG:
        acc = acc * _BASE + data[at].astype(np.uint64) + np.uint64(1)
        k += 1
        more = size[live] > k
        if k in heads:
            heads[k][live[more]] = mixed(acc[more] + np.uint64(k))
        if not more.all():
            done = ~more
            h[live[done]] = acc[done]
            live, acc, at = live[more], acc[more], at[more]
        at = at + 1
    if live.size:  # long runs, block by block: the same polynomial
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(1 << 16, _BASE)]))
        for i, value, a in zip(live.tolist(), acc, at.tolist(), strict=True):
            for b in range(a, int(ends[i]), 1 << 16):
                piece = data[b : min(b + (1 << 16), int(ends[i]))].astype(np.uint64) + np.uint64(1)
                value = np.array([value]) * powers[len(piece)] + (piece * powers[: len(piece)][::-1]).sum(dtype=np.uint64)
                value = value[0]
            h[i] = value
    return [mixed(h), *heads.values()]


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of rows; an empty segment sums to zero."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(counts)
    if full.size:
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


def filtered(docs: DataFrame, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text ``judge`` accepts; no join, no shuffle."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at)), pa.bool_()))

    return in_batches(docs, work, docs.schema)


def sized(ids: DataFrame) -> DataFrame:
    """Written rows of an id and a number or two, marked for a broadcast if they are at most SMALL; else a join shuffles."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.limit(SMALL + 1).count() <= SMALL else ids


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in ``gone`` (key). Up to SMALL ids are broadcast, more are joined by a shuffle."""
    name = unused(docs, "_gone")
    gone = sized(gone.select(F.col(key).alias(name)).where(F.col(name).isNotNull()).distinct())
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")
