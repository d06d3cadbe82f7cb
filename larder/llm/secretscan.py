"""Secret scans with structural confirmation.

Three kinds of spans come from patterns alone (``assign``, ``access``, ``hex``). Three more are reported only once their
bytes have been decoded and read as what they claim to be:

- ``jwt``: three base64url parts; the header is a JSON object whose ``alg`` is a signature, the claims are a JSON
  object, and the signature has the length that this ``alg`` makes.
- ``pem``: a block between BEGIN and END lines of a private key whose base64 body is a private key.
- ``key``: a run of base64 or hexadecimal digits that is a private key.

A private key is DER whose nested lengths fit exactly and whose fields are those of PKCS #8 (plain or encrypted),
PKCS #1, SEC 1 or DSA, or the ``openssh-key-v1`` encoding with all its lengths. Public keys and certificates are no secrets.

Spans are code points of the whole text, the end exclusive, ordered by start and then by kind as listed; those of
different kinds may overlap. Null and empty texts have none. A text is scanned in time in proportion to its length:
a run is decoded once, and only if its first bytes may begin a key. Rows come out one for one, repeated rows and null
ids included; columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
from binascii import Error
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table

KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
#: The kinds that patterns alone find.
BASE = KINDS[:3]
# The patterns of these kinds, and the least lengths of a value, an access key and a hexadecimal run.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}+")
#: Digits below which a bare run holds no private key (an Ed25519 key has 48 bytes).
LEAST_BASE64, LEAST_HEX_KEY = 64, 96
_RUN64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_BASE64},}}+(?:={{1,2}}+)?")
_RUN16 = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{{LEAST_HEX_KEY},}}+")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|\\[nr])*+)-----END \1-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{16,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{43,}+)(?![.=])")
# Bytes of a signature by its algorithm (RSA: at least), the object identifiers under which key
# encryption stands, and what an OpenSSH key begins with.
SIGNED = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
RSA, LEAST_RSA = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), 128
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))
_OPENSSH = b"openssh-key-v1\0"
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE, _ZERO, _ONE = 0x02, 0x03, 0x04, 0x06, 0x30, 0xA0, 0xA1
#: Levels to which DER may nest.
DEPTH = 16


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the kinds that patterns find; a match that is too short is dropped, and what it took is not sought again."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER value at a position; None if its length is not written in the one right way."""
    if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
        return None
    size, start = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        start += n
        if not 1 <= n <= 4 or start > len(data) or data[at + 2] == 0:
            return None
        size = int.from_bytes(data[at + 2 : start], "big")
        if size < 0x80:
            return None
    return data[at], start, start + size


def parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER values that fill a range exactly, or None."""
    out = []
    while at < end:
        one = header(data, at)
        if one is None or one[2] > end:
            return None
        out.append(one)
        at = one[2]
    return out


def nested(data: bytes, at: int, end: int, depth: int = 0) -> bool:
    """Whether DER values fill a range exactly, and so do those within each constructed one."""
    held = parts(data, at, end)
    return held is not None and depth <= DEPTH and all(nested(data, start, stop, depth + 1) for tag, start, stop in held if tag & 0x20)


def der_private_key(data: bytes) -> bool:
    """Whether bytes are one private key in DER, nothing missing and nothing over."""
    top = header(data, 0)
    if top is None or top[0] != _SEQUENCE or top[2] != len(data):
        return False
    held = parts(data, top[1], top[2])
    if not held or not nested(data, top[1], top[2]):
        return False
    tags = [tag for tag, _, _ in held]
    inner = lambda k: data[held[k][1] : held[k][2]]
    names = lambda k: (first := header(inner(k), 0)) is not None and first[0] == _OID and inner(k)[first[1] : first[2]]  # noqa: E731  the identifier a sequence begins with
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:  # PKCS #8
        return inner(0) in (b"\0", b"\1") and bool(names(1)) and all(t in (_ZERO, _ONE, 0x81) for t in tags[3:]) and nested(inner(2), 0, len(inner(2)))
    if tags == [_SEQUENCE, _OCTETS]:  # PKCS #8, encrypted
        return bool(names(0)) and names(0).startswith(_ENCRYPTION) and len(inner(1)) >= 16
    if tags[:9] == [_INTEGER] * 9 and len(tags) <= 10:  # PKCS #1
        return inner(0) in (b"\0", b"\1") and all(len(inner(k)) for k in range(9)) and len(inner(1)) >= 64
    if tags == [_INTEGER] * 6:  # DSA
        return inner(0) == b"\0" and len(inner(1)) >= 64 and all(len(inner(k)) for k in range(6))
    if tags[:2] == [_INTEGER, _OCTETS]:  # SEC 1
        return inner(0) == b"\1" and len(inner(1)) >= 16 and len(tags) > 2 and all(t in (_ZERO, _ONE) for t in tags[2:])
    return False


def openssh_private_key(data: bytes) -> bool:
    """Whether bytes are one ``openssh-key-v1`` key whose lengths fit exactly."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)

    def string() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        held = data[at + 4 : at + 4 + size]
        at += 4 + size
        return held if len(held) == size else None

    head = [string() for _ in range(3)]  # cipher, key derivation, its options
    if None in head or not head[0] or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return False
    public = [string() for _ in range(keys)]
    private = string()
    return None not in public and all(public) and bool(private) and at == len(data)


def private_key(data: bytes) -> bool:
    return der_private_key(data) or openssh_private_key(data)


def _decoded(digits: str) -> bytes | None:
    """Bytes of base64 digits of either alphabet, padded or not; None if they are no base64."""
    bare = digits.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except Error:
        return None


def signed_token(head: str, claims: str, signature: str) -> bool:
    """Whether three parts of base64url digits are a signed token."""
    raw = [_decoded(x) for x in (head, claims, signature)]
    if None in raw or raw[0][:1] != b"{" or raw[1][:1] != b"{":
        return False
    try:
        said, held = json.loads(raw[0]), json.loads(raw[1])
    except (ValueError, RecursionError):
        return False
    if not isinstance(said, dict) or not isinstance(held, dict) or not isinstance(said.get("alg"), str):
        return False
    return len(raw[2]) in SIGNED.get(said["alg"], ()) or said["alg"] in RSA and len(raw[2]) >= LEAST_RSA


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the kinds whose bytes have been read."""
    found = [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if signed_token(*m.groups())] if "." in text else []
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            data = _decoded(re.sub(r"\\[nr]|\s", "", m[2]))
            if data and private_key(data):
                found.append(("pem", m.start(), m.end()))
    begins = lambda data: data is not None and (data[:1] == b"\x30" or _OPENSSH.startswith(data[:15]))
    for m in _RUN64.finditer(text):
        if begins(_decoded(m[0][:20])) and (data := _decoded(m[0])) and private_key(data):
            found.append(("key", m.start(), m.end()))
    for m in _RUN16.finditer(text):
        if len(m[0]) % 2 == 0 and begins(bytes.fromhex(m[0][:30])) and private_key(bytes.fromhex(m[0])):
            found.append(("key", m.start(), m.end()))
    return found


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, in order."""
    text = text or ""
    return sorted(set(base_spans(text) + confirmed_spans(text)), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans(text.as_py())] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, work, f"doc_id long, spans {_SPANS}")


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, every = scanned(table(spark, sf_dir, "documents")), F.col("spans")
    of = lambda *kinds: F.filter(every, lambda x: x["kind"].isin(*kinds))
    counts, base = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], listed(of(*BASE))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(every).alias("spans"))
