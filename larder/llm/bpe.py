"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut only where no match of the split pattern can span: before a whitespace that follows a
non-whitespace. A run of whitespace too long for the regex engine is one match by the pattern, so it goes to
the merges as one piece. Decoding joins the raw bytes of the ids.

Null text counts as empty: no ids, the digest of the empty string. Texts of any length are encoded whole.
Rows come out one for one, repeated rows included; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a text that the library gets at once, and the longest run of whitespace left to its regex engine.
PIECE, LONG_RUN = 1 << 16, 2048
_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
_RUNS = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")


@lru_cache(4)
def encoding(rank_file: str = RANKS) -> tiktoken.Encoding:
    """The encoder of a rank file in the folder of public tokenizers, or of a path; built once a process."""
    path = rank_file if "/" in rank_file else public_tokenizers.path(rank_file)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut where no match of the pattern spans."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found or found.start() == len(text):
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _ids(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text; each overlong run of whitespace is the match that the pattern makes of it."""
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    out, start = [], 0
    for found in _RUNS.finditer(text):
        end = found.end() if found.end() == len(text) else found.end() - 1
        out += enc.encode_ordinary(text[start : found.start()])
        out += enc._encode_single_piece(text[found.start() : end])
        start = end
    return out + enc.encode_ordinary(text[start:])


def encode(text: str | None, rank_file: str = RANKS) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if not text:
        return np.zeros(0, "<u4")
    enc = encoding(rank_file)
    parts = [np.array(_ids(enc, piece), "<u4") for piece in safe_pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, rank_file: str = RANKS) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8."""
    return encoding(rank_file).decode_bytes(ids.tolist())


def encoded(docs: DataFrame, rank_file: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # bounds what a task holds beside its input batch
                part = batch.slice(k, 256)
                ids = [encode(t, rank_file) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decode(x, rank_file) for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").transform(in_batches, work, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, rank_file: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes: ``encoded`` without moving its payloads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py(), rank_file)
                n.append(len(ids))
                ids_sha.append(sha(ids.tobytes()))
                text_sha.append(sha(decode(ids, rank_file)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").transform(in_batches, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
