"""The catalogue's tables derived from the fixed Parquet tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

import re
from functools import cached_property

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog import Catalog
from ..sources.shared import shared_folder

if TYPE_CHECKING:
    from ..operators.textindex import Segments

#: Where an application has stored the text index of a folder's tables.
_STORED: dict[tuple[str, str], str] = {}
#: name: (the table in SQL that Spark and DuckDB share, or a text for each).
_ASSET = """
select doc_id as id, case lang when 'en' then 'image' when 'de' then 'model3d' when 'fr' then 'audio' else 'reference' end as kind,
  {key} as content_hash, {title} as title, text as notes,
  case doc_id % 3 when 0 then null when 1 then '' else concat('The image shows ', lower({title}), '. More follows.') end as caption,
  case doc_id % 7 when 0 then '' when 1 then null else concat('https://www.', source, '.example.com/', cast(doc_id as {text})) end as source_url, source as source_name,
  case doc_id % 5 when 0 then null when 1 then '' when 2 then 'CC0' when 3 then 'CC-BY 4.0' else 'Proprietary' end as license,
  doc_id % 4 = 0 as managed, cast('2024-01-01 00:00:00' as {ntz}) + {minutes} as added_at, cast('2024-06-01 00:00:00' as {ntz}) + {minutes2} as updated_at
from documents where doc_id is not null"""
_ROOT = """
select * from (values (1, '/lib/urgent', '1-urgent', 'indexed', false), (2, '/lib/high', '2-high', 'managed', true), (3, '/lib/medium', '3-medium', 'indexed', false), (4, '/lib/low', '5-low', 'indexed', true), (5, '/lib/high/other', '4-not-specified', 'managed', false)) as r(id, path, name, mode, vendor)"""
_LOCATION = """
select o_orderkey as id, o_custkey - 1 as asset_id, {root} as root_id, {path} as abs_path, {size} as size, o_orderdate as mtime,
  o_orderdate as last_seen, o_orderkey % 6 <> 0 and o_custkey % 9 <> 0 as present
from orders"""
_ROOT_OF = "case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 when '5-LOW' then 4 else 5 end"
_DIR_OF = "case o_orderpriority when '1-URGENT' then '/lib/urgent/' when '2-HIGH' then '/lib/high/' when '3-MEDIUM' then '/lib/medium/' when '5-LOW' then '/lib/low/' else '/lib/high/other/' end"
_PATH = f"concat({_DIR_OF}, case o_orderstatus when 'F' then 'Harbour/NightBoats/' when 'O' then 'Paving/assets/' else 'HUDDials/' end, case o_orderkey % 3 when 0 then 'ferryBell_' when 1 then 'Quay_Lamp_v' else 'HUDLever-' end, cast(o_orderkey as {{text}}), case o_orderkey % 5 when 0 then '.PNG' when 1 then '.fbx' when 2 then '_preview.png' when 3 then '.wav' else '.cs' end)"
_TAGS = """
select doc_id as asset_id, concat('lang-', lang) as name, 'type' as namespace, 'structural' as source, cast(null as double) as confidence from documents
union all select doc_id, source, 'source', 'structural', null from documents
union all select doc_id, 'good', 'style', 'manual', 0.9 from labels where quality = 1
union all select doc_id, 'toxic', 'style', 'manual', 0.8 from labels where toxic = 1
union all select doc_id, {word}, null, 'heuristic', 0.5 from documents where {word} <> ''
union all select doc_id, 'good', 'style', 'heuristic', 0.5 from documents where n_chars > 3000"""
_ATTRIBUTE = """
select doc_id as asset_id, 'bytes' as key, cast(null as {text}) as value_text, cast(n_chars as double) as value_num from documents
union all select doc_id, 'width', null, cast(32 + doc_id * 7 % 1000 as double) from documents where lang = 'en'
union all select doc_id, 'height', null, cast(32 + doc_id * 11 % 700 as double) from documents where lang = 'en'
union all select doc_id, 'color_count', null, cast(1 + n_chars % 600 as double) from documents where lang = 'en'
union all select doc_id, 'frame_count', null, cast(doc_id % 3 as double) from documents where lang = 'en'
union all select doc_id, 'has_alpha', null, cast(doc_id % 2 as double) from documents where lang = 'en'
union all select doc_id, 'triangles', null, cast(n_chars as double) from documents where lang = 'de'
union all select doc_id, 'has_rig', null, cast(doc_id % 2 as double) from documents where lang = 'de'
union all select doc_id, 'animation_count', null, cast(doc_id % 3 as double) from documents where lang = 'de'
union all select doc_id, 'duration', null, n_chars / 100.0E0 from documents where lang = 'fr'
union all select doc_id, 'channels', null, cast(1 + doc_id % 2 as double) from documents where lang = 'fr'
union all select doc_id, 'peak_db', null, cast(-(doc_id % 500) as double) / 10.0E0 from documents where lang = 'fr'
union all select doc_id, 'host', concat('www.', source, '.example.com'), null from documents where lang = 'es'"""
_EMBEDDING = "select vec_id as asset_id, case when label < 6 then 'old' else 'new' end as model, embedding as vector from embeddings"
_COLLECTION = "select s_suppkey as id, concat('set-', cast(s_suppkey as {text})) as name, s_name as notes from supplier"
_MEMBERS = """
select collection_id, asset_id, cast(row_number() over (partition by collection_id order by first, asset_id) as bigint) as position
from (select l_suppkey as collection_id, l_partkey - 1 as asset_id, min(l_orderkey) as first from lineitem group by l_suppkey, l_partkey - 1) m"""

_SPARK = {
    "text": "string", "ntz": "timestamp_ntz", "minutes": "make_dt_interval(0, 0, cast(doc_id * 37 % 100000 as int))", "minutes2": "make_dt_interval(0, 0, cast(doc_id * 53 % 100000 as int))",
    "key": "substring(sha2(cast(text as binary), 256), 1, 32)", "title": "substring_index(text, ' ', 4)", "size": "cast(round(o_totalprice * 100) as bigint)",
    "word": "regexp_replace(lower(substring_index(text, ' ', 1)), '[^a-z0-9]', '')", "tag_id": "cast(conv(substring(md5(name), 1, 12), 16, 10) as bigint)",
}
_DUCK = {
    "text": "varchar", "ntz": "timestamp", "minutes": "to_minutes(doc_id * 37 % 100000)", "minutes2": "to_minutes(doc_id * 53 % 100000)",
    "key": "substring(sha256(text), 1, 32)", "title": "array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ')", "size": "cast(round(o_totalprice * 100) as bigint)",
    "word": "regexp_replace(lower(split_part(text, ' ', 1)), '[^a-z0-9]', '', 'g')", "tag_id": "cast(('0x' || substring(md5(name), 1, 12)) as bigint)",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _texts(words: dict[str, str]) -> dict[str, str]:
    path = _PATH.format(**words)
    named = _TAGS.format(**words)
    return {
        "root": _ROOT, "asset": _ASSET.format(**words), "location": _LOCATION.format(**words, root=_ROOT_OF, path=path), "named_tag": named,
        "tag": f"select distinct {words['tag_id']} as id, name, namespace from named_tag union all select 1, 'never-used', null",
        "asset_tag": f"select asset_id, {words['tag_id']} as tag_id, source, confidence from named_tag",
        "attribute": _ATTRIBUTE.format(**words), "embedding": _EMBEDDING, "collection": _COLLECTION.format(**words), "collection_asset": _MEMBERS,
    }


def sql(body: str) -> str:
    """A DuckDB query over the stand-ins: ``body`` may name them, and may begin with ``with``."""
    own = _texts(_DUCK)
    known = ", ".join(f"{n} as ({t})" for n, t in own.items())
    body = body.strip()
    return f"with {known}, {body[4:].lstrip()}" if body.lower().startswith("with ") else f"with {known} {body}"


class Tables:
    """The fixed tables of a folder by name, and the catalogue's tables derived from them."""

    phash = None

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in _TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def index(self) -> Segments:
        """The text index of the items, all five fields, stored beside a catalogue once an application and folder; searches read the buckets of their words."""
        from ..operators.aggregates import text_docs
        from ..operators.textindex import Segments, TextIndex

        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _STORED:
            folder = shared_folder(self.spark)
            TextIndex(text_docs(self)).store(Catalog(self.spark, folder))
            _STORED[key] = folder
        return Segments(Catalog(self.spark, _STORED[key]).snapshot())

    def _from(self, name: str, parts: tuple[str, ...]) -> DataFrame:
        """SQL over frames given by name, without naming anything in the session."""
        text = _texts(_SPARK)[name]
        for p in parts:
            text = _in_braces(text, p)
        return self.spark.sql(text, **{p: getattr(self, p) for p in parts})

    @cached_property
    def root(self) -> DataFrame:
        return self.spark.sql(_texts(_SPARK)["root"])

    @cached_property
    def asset(self) -> DataFrame:
        return self._from("asset", ("documents",))

    @cached_property
    def location(self) -> DataFrame:
        return self._from("location", ("orders",))

    @cached_property
    def named_tag(self) -> DataFrame:
        return self._from("named_tag", ("documents", "labels"))

    @cached_property
    def tag(self) -> DataFrame:
        return self._from("tag", ("named_tag",))

    @cached_property
    def asset_tag(self) -> DataFrame:
        return self._from("asset_tag", ("named_tag",))

    @cached_property
    def attribute(self) -> DataFrame:
        return self._from("attribute", ("documents",))

    @cached_property
    def embedding(self) -> DataFrame:
        return self._from("embedding", ("embeddings",))

    @cached_property
    def collection(self) -> DataFrame:
        return self._from("collection", ("supplier",))

    @cached_property
    def collection_asset(self) -> DataFrame:
        return self._from("collection_asset", ("lineitem",))


def _in_braces(text: str, name: str) -> str:
    """``from name`` as a reference to a frame argument."""
    return re.sub(rf"(?i)\bfrom {name}\b", f"from {{{name}}}", text)
