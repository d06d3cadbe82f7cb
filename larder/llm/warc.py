"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing: a page is a response record, or a revisit of the response with an equal payload; the HTTP body is chunked, and
a block longer than ``SEGMENT`` goes on in continuation records. Spark's text writer ends each record with the two
line ends that WARC asks for, so the files are plain WARC.

Reading: Spark's text reader cuts the (splittable) files where a record begins; chunk boundaries keep that separator
out of the payloads. Records are told apart by their parsed fields. Segments are grouped by origin identifier, ordered
by segment number, checked for gaps and against the total length, joined, and the chunked framing is decoded. A record
that fails a check, or whose numbers cannot be read, keeps its row, with ``error`` set and no payload; so do records
of archives written elsewhere that a separator in their payload cuts in two, and segments without an origin. A task
holds one record at a time beside its batch.

A null html is an empty payload. Rows that repeat a page_id are separate records. A null page_id is written as empty
and read as null; it is never what a revisit refers to. Empty tables give no records. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from uuid import NAMESPACE_OID, uuid4, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL, cut, in_batches, shared_folder, table

#: Bytes of a block in one record, bytes of a chunk of the body, bytes of the smallest payload that others may revisit.
SEGMENT, CHUNKED, LEAST = 32 << 10, 8 << 10, 100
#: Fixed values of the format.
VERSION, END = b"WARC/1.1\r\n", "\r\n\r\n"
SEPARATOR = END.encode() + VERSION
_HEX = re.compile(rb"[0-9A-Fa-f]{1,15}")
_WHOLE = re.compile(r"-?[0-9]{1,18}|-?[0-9]{19}")
_RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with an equal payload of at least LEAST bytes, null if the row's own."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html").withColumn("digest", F.when(F.octet_length(payload) >= LEAST, F.sha2(payload, 256)))
    shared = cut(pages.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_digest"), "first"))
    small = shared.limit(SMALL // 10 + 1).count() <= SMALL // 10
    joined = pages.join(F.broadcast(shared) if small else shared, F.col("digest") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "html", F.when(F.col("first") != F.coalesce("page_id", F.lit(-1)), F.col("first")).alias("refers_to"))


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing; no chunk holds the record separator."""
    cuts = set(range(CHUNKED, len(payload), CHUNKED))
    at = payload.find(SEPARATOR)
    while at >= 0:
        cuts.add(at + len(END))
        at = payload.find(SEPARATOR, at + 1)
    edges = [0, *sorted(cuts), len(payload)]
    return b"".join(b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip(b" \t")
        if not _HEX.fullmatch(digits):
            raise ValueError("broken chunk size")
        size = int(digits, 16)
        if not size:
            return b"".join(parts)
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(body[end + 2 : at])
        at += 2


def record_id(page_id: int, digest: str) -> str:
    """The identifier of a page's response with that payload, so that a revisit can name it without a look-up; equal rows have equal ones."""
    return f"<urn:uuid:{uuid5(NAMESPACE_OID, f'{page_id} {digest}')}>"


def number(text: str | None) -> int | None:
    """A 64-bit whole number, or None."""
    value = int(text) if text and _WHOLE.fullmatch(text) else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The WARC records of a page, each without the line ends that close it."""
    payload = (html or "").encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = head + b"\r\n" if refers_to is not None else head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = f"<urn:uuid:{uuid4()}>" if page_id is None or refers_to is not None or len(payload) < LEAST else record_id(page_id, "sha256:" + hashlib.sha256(payload).hexdigest())
    uri = "".join(c for c in url or "" if c not in "\r\n")
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        fields = {"WARC-Type": ("response" if refers_to is None else "revisit") if k == 1 else "continuation", "WARC-Record-ID": first if k == 1 else f"<urn:uuid:{uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": uri}
        if k == 1:
            fields |= {"WARC-Page-ID": "" if page_id is None else str(page_id), "WARC-Payload-Digest": "sha256:" + hashlib.sha256(payload).hexdigest(), "Content-Type": "application/http; msgtype=response"}
            if refers_to is not None:
                fields |= {"WARC-Refers-To": record_id(refers_to, fields["WARC-Payload-Digest"]), "WARC-Refers-To-Page": str(refers_to)}
        if len(parts) > 1:
            fields["WARC-Segment-Number"] = str(k)
            if k > 1:
                fields["WARC-Segment-Origin-ID"] = first
            if k == len(parts):
                fields["WARC-Segment-Total-Length"] = str(len(block))
        fields["Content-Length"] = str(len(part))
        yield VERSION + "".join(f"{a}: {b}\r\n" for a, b in fields.items()).encode() + b"\r\n" + part


def write(pages: DataFrame, path: str) -> None:
    """Write typed() pages as WARC files under ``path``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = zip(*[c.to_pylist() for c in batch.slice(k, 512).columns], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([x for row in rows for x in records(*row)], pa.binary())], names=["value"])

    made = pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).transform(in_batches, work, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", END).text(path)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, str | None]:
    """Header fields, block, and what is wrong with a record's bytes."""
    head, _, rest = raw.removeprefix(VERSION).partition(END.encode())
    fields = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in head.decode(errors="replace").split("\r\n")) if a}
    size = number(fields.get("content-length"))
    if size is None or size < 0:
        return fields, b"", "no length"
    return fields, rest[:size], None if len(rest) >= size and not rest[size:].strip(b"\r\n") else "length differs"


def _row(fields: dict[str, str], block: bytes, error: str | None, payloads: bool) -> tuple:
    """A row of _RECORD from a whole block."""
    refers, page, kind = number(fields.get("warc-refers-to-page")), number(fields.get("warc-page-id")), fields.get("warc-type")
    error = error or next((f"{name} is no number" for name in ("warc-page-id", "warc-refers-to-page") if fields.get(name) and number(fields[name]) is None), None)
    declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if error or kind == "revisit":
        return page, kind, refers, None, declared, None, error
    head, _, body = block.partition(b"\r\n\r\n")
    try:
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError:
        return page, kind, refers, None, declared, None, "broken chunks"
    digest = hashlib.sha256(payload).hexdigest()
    return page, kind, refers, len(payload), digest, payload if payloads else None, None if digest == declared or not declared else "digest differs"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row of _RECORD for every response and revisit under ``path``, segments joined; payload is null if not asked for."""
    raw = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    raw = raw.where(F.length("value") > 0)
    # a cheap test in the JVM; whether the record is a segment, its parsed fields say
    in_parts = F.contains(F.lower(F.substring_index("value", END, 1)), F.lit("warc-segment-number:"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                yield _table([_row(*parse(x.as_py()), payloads) for x in batch.column(0).slice(k, 512)])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, segment = [], []
            for x in batch.column(0):
                fields = parse(x.as_py())[0]
                part = "warc-segment-number" in fields
                segment.append((number(fields["warc-segment-number"]) or -1) if part else None)  # null: a whole record
                origin.append(fields.get("warc-segment-origin-id") or fields.get("warc-record-id") or f"<{uuid4()}>" if part else f"<{uuid4()}>")
            yield pa.RecordBatch.from_arrays([pa.array(origin, pa.string()), pa.array(segment, pa.int64()), batch.column(0).cast(pa.binary())], names=["origin", "segment", "value"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, held, copies, fields, wrong, total = None, [], [], {}, None, None

        def done() -> pa.RecordBatch:
            block = b"".join(held)
            bad = wrong or ("no first segment" if number(fields.get("warc-segment-number")) != 1 else "no last segment" if total is None else "total length differs" if number(total) != len(block) else None)
            if min(copies) < max(copies):
                bad, copies[:] = bad or "a segment is repeated", [1]
            return _table([_row(fields, block, bad, payloads)] * copies[0])

        for batch in batches:
            for name, segment, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if segment is None:
                    yield _table([_row(*parse(raw), payloads)])
                    continue
                if name != origin or not held:
                    if held:
                        yield done()
                    origin, held, copies, fields, wrong, total = name, [], [], {}, None, None
                now, block, error = parse(raw)
                if held and segment == len(held) and block == held[-1]:  # a record that is there again, all of its segments
                    copies[-1] += 1
                    continue
                wrong = wrong or error or (None if segment == len(held) + 1 else f"segment {len(held) + 1} is missing or repeated")
                fields = fields or now
                total = now.get("warc-segment-total-length", total)
                held.append(block)
                copies.append(1)
        if held:
            yield done()

    binary = F.col("value").cast("binary").alias("value")
    parts = raw.where(in_parts).select(binary).transform(in_batches, keyed, "origin string, segment long, value binary")
    parts = parts.repartition("origin").sortWithinPartitions("origin", "segment").transform(in_batches, joined, _RECORD)
    return raw.where(~in_parts).select(binary).transform(in_batches, whole, _RECORD).union(parts)


def resolved(found: DataFrame) -> DataFrame:
    """read() rows with the payload's size of each revisit taken from the response that it refers to.

    A response may have a third of all records as revisits. A join right above an aggregate on its key is never taken
    as skewed; by the key's complement the responses are shuffled once more, and adaptive execution can split it.
    """
    visits = found.where("record_type = 'revisit'")
    firsts = found.where("record_type = 'response' and error is null and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    firsts = firsts.select(F.bitwise_not("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "_bytes")
    visits = visits.join(firsts, (F.bitwise_not("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    visits = visits.select("page_id", "record_type", "refers_to", F.col("_bytes").alias("payload_bytes"), "payload_digest", "payload", F.when(F.col("_bytes").isNull(), F.coalesce("error", F.lit("no such response"))).otherwise(F.col("error")).alias("error"))
    return found.where("record_type is null or record_type <> 'revisit'").unionByName(visits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark, 'warc')}/archives"
    write(typed(table(spark, sf_dir, "pages")), path)
    found = resolved(cut(read(spark, path, payloads=False)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
     d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
     f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest, case when f.first <> d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first <> d.page_id then f.first end as refers_to, null::varchar as error
from d left join f on d.payload_digest = f.payload_digest and d.payload_bytes >= 100
"""
