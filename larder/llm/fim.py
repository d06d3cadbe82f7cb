"""Fill-in-the-middle transformation by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of its group, so ``match.ends(1)`` holds
the ends of all units of a text: their number and both cuts come from it, without a loop over the text. A unit is a
run of other characters with the white space before it; white space at the end of a text is a unit of its own.

Where a text is cut and in which form it is written follows from its doc_id and a seed alone. Texts that hold a
marker stay plain, so every output can be taken apart again, by JVM functions. Null texts are empty, and empty texts
stay plain; a null doc_id draws like an id without digits. Texts are taken whole: the ends of a text's units are a
list in its task, about 36 bytes a unit. Rows come out one for one, repeated rows included; other columns than doc_id
and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The seed of the draws; of a hundred texts so many are transformed, and of those so many begin with the suffix.
SEED, RATE, SPM = 42, 50, 80
#: Rows whose outputs a task holds at once.
ROWS = 256
_UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")


def ends(text: str) -> list[int]:
    """Where each unit of a text ends, in code points; the last end is the length of the text."""
    return _UNITS.fullmatch(text).ends(1)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    head = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(head[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(doc_id: int | None, text: str | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form (plain, psm or spm), code points of prefix and middle (None if plain), output."""
    text = text or ""
    at = ends(text)
    n, (one, two, three, four) = len(at), draws(doc_id, seed)
    if not text or three % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (at[k - 1] if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
    head, middle, tail = text[:low], text[low:high], text[high:]
    if four % 100 < spm:
        return n, "spm", low, high - low, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, the text as a model is trained on it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                ids, texts = (c.to_pylist() for c in batch.slice(k, ROWS).columns)
                made = list(zip(*[transform(i, t, seed, rate, spm) for i, t in zip(ids, texts, strict=True)], strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(ids, pa.int64()), *[pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(in_batches, work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text from which an output was made."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # nothing, then three parts; none of them holds a marker
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored("output", "form")).alias("restored_sha256"))


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
     u as (select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t),
     v as (select *, len(units) as n, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form,
                  least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as high from u),
     w as (select *, array_to_string(units[1:low], '') as p, array_to_string(units[low + 1:high], '') as m, array_to_string(units[high + 1:], '') as s from v)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from w
"""
