"""Queries of filters, joins, aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import hamming
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import neighbours as V
from ..operators import ranking as W
from ..sources.catalog import Catalog
from ..sources.shared import shared_folder
from .registry import query

ids = lambda df: df.select("id")
_EXISTS_TAG = "exists (select 1 from asset_tag t join tag g on g.id = t.tag_id where t.asset_id = a.id and g.name = '{}')"
_ATTR = "exists (select 1 from attribute t where t.asset_id = a.id and t.key = '{}' and t.value_num {})"

for name, kw, cond in (
    ("p1_tag", {"tags": ["Good"], "not_tags": ["toxic"]}, f"{_EXISTS_TAG.format('good')} and not {_EXISTS_TAG.format('toxic')}"),
    ("p2_kind", {"kind": "Image"}, "kind = 'image'"),
    ("p3_license", {"license": "cc%by", "not_source": "src1"}, "license ilike '%cc%by%' and not source_name ilike '%src1%'"),
    ("p3_not_license", {"not_license": "cc"}, "not license ilike '%cc%'"),
    ("p4_root", {"root": "2 High"}, "exists (select 1 from location l join root r on r.id = l.root_id where l.asset_id = a.id and (r.name = '2-high' or r.path ilike '%2 High%'))"),
    ("p5_collection", {"collection": "Set 7"}, "exists (select 1 from collection_asset c join collection s on s.id = c.collection_id where c.asset_id = a.id and s.name = 'set-7')"),
    ("p6_number", {"num": [("w", ">=", "512"), ("size", "<", "4kb"), ("nope", ">", "1"), ("h", ">", "wide")]}, f"{_ATTR.format('width', '>= 512')} and {_ATTR.format('bytes', '< 4096')}"),
    ("p6_not_number", {"not_num": [("w", ">=", 512)]}, f"not {_ATTR.format('width', '>= 512')}"),
    ("p7_has_attribute", {"has": ["alpha"], "not_has": ["frames"]}, f"{_ATTR.format('has_alpha', '> 0')} and not {_ATTR.format('frame_count', '> 0')}"),
    ("p8_has_column", {"has": ["caption", "license"], "not_has": ["source"]}, "caption is not null and caption <> '' and license is not null and license <> '' and not (source_url is not null and source_url <> '')"),
    ("p9_managed", {"is_": "managed"}, "managed"),
    ("p10_missing", {"is_": "missing"}, "kind <> 'reference' and not exists (select 1 from location l where l.asset_id = a.id and l.present)"),
    ("p11_untagged", {"is_": "untagged"}, "not exists (select 1 from asset_tag t where t.asset_id = a.id and t.source <> 'structural')"),
    ("p12_vendor", {"is_": "vendor"}, "exists (select 1 from location l join root r on r.id = l.root_id where l.asset_id = a.id and r.vendor)"),
    ("p13_clipping", {"is_": "clipping"}, _ATTR.format("peak_db", ">= -0.1")),
    ("p13_silent", {"is_": "silent"}, _ATTR.format("peak_db", "< -40")),
    ("p14_mono", {"is_": "mono", "not_is": "stereo"}, _ATTR.format("channels", "= 1")),
    ("p15_unknown", {"is_": "odd", "has": "odder", "kind": "audio"}, "kind = 'audio'"),
):
    query(name, f"select id from asset a where {cond}")(lambda t, kw=kw: ids(P.find(t, **kw)))


@query("p16_decorate", """select a.id, a.title, p.abs_path, p.present, w.width, w.height from asset a
    left join (select *, row_number() over (partition by asset_id order by present desc, id) as r from location) p on p.asset_id = a.id and p.r = 1
    left join (select asset_id, max(case key when 'width' then value_num end) as width, max(case key when 'height' then value_num end) as height from attribute where key in ('width', 'height') group by 1) w on w.asset_id = a.id
    where a.kind = 'image'""")  # fmt: skip
def _(t):
    return W.decorate(P.find(t, kind="image"), t, ["width", "height"]).select("id", "title", "abs_path", "present", "width", "height")


_TERMS = "(values (1, 'kind', '=', 'image', false), (1, 'width', '>=', '500', false), (2, 'tag', '=', 'Good', false), (2, 'tag', '=', 'toxic', true), (3, 'bytes', '<', '1kb', false), (3, 'kind', '=', 'image', true), (4, 'tag', '=', 'lang-en', false), (4, 'height', '<', '100', false), (4, 'bytes', '>', '512', false))"


@query("p17_saved_searches", """select 1::bigint as query_id, id from asset a where kind = 'image' and """ + _ATTR.format("width", ">= 500")
    + " union all select 2, id from asset a where " + _EXISTS_TAG.format("good") + " and not " + _EXISTS_TAG.format("toxic")
    + " union all select 3, id from asset a where " + _ATTR.format("bytes", "< 1024") + " and kind <> 'image'"
    + " union all select 4, id from asset a where " + _EXISTS_TAG.format("lang-en") + " and " + _ATTR.format("height", "< 100") + " and " + _ATTR.format("bytes", "> 512"))
def _(t):
    terms = t.spark.sql(f"select cast(query_id as bigint) as query_id, field, op, value, negated from values {_TERMS[8:-1]} as v(query_id, field, op, value, negated)")
    return P.saved_searches(terms, t).select("query_id", "id")


@query("p18_detail", """with tg as (select t.asset_id, string_agg(concat(t.source, '/', g.name), ',' order by t.source, g.name) as tags from asset_tag t join tag g on g.id = t.tag_id group by 1),
    lo as (select asset_id, string_agg(abs_path, ',' order by present desc, id) as locations from location group by 1),
    se as (select c.asset_id, string_agg(s.name, ',' order by s.name) as sets from collection_asset c join collection s on s.id = c.collection_id group by 1)
    select a.id, a.title, tg.tags, lo.locations, se.sets from asset a left join tg on tg.asset_id = a.id left join lo on lo.asset_id = a.id left join se on se.asset_id = a.id""")  # fmt: skip
def _(t):
    text = lambda c, f: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, f), ","))
    return P.detail(t).select("id", "title", text("tags", lambda x: F.concat(x["source"], F.lit("/"), x["name"])).alias("tags"), text("locations", lambda x: x["abs_path"]).alias("locations"), text("collections", lambda x: x).alias("sets"))


@query("j1_inner", "select t.asset_id, g.name, g.namespace, t.source from asset_tag t join tag g on g.id = t.tag_id")
def _(t):
    return P.named_tags(t).select("asset_id", "name", "namespace", "source")


@query("j2_left_count", "select c.id, c.name, count(m.asset_id) as n from collection c left join collection_asset m on m.collection_id = c.id group by all")
def _(t):
    return J.count_right(t.collection, t.collection_asset, "id", "collection_id").select("id", "name", "n")


@query("j3_left_on", "select a.id, count(l.id) as n from asset a left join location l on l.asset_id = a.id and l.present group by 1")
def _(t):
    return J.count_right(t.asset, t.location, "id", "asset_id", F.col("present")).select("id", "n")


@query("j4_semi", "select id from asset a where exists (select 1 from location l where l.asset_id = a.id and l.size > 20000000)")
def _(t):
    return ids(P.having(t.asset, t.location, F.col("size") > 20_000_000))


@query("j5_anti", "select id from asset a where not exists (select 1 from embedding e where e.asset_id = a.id and e.model = 'old')")
def _(t):
    return ids(P.lacking(t.asset, t.embedding, F.col("model") == "old"))


_QV = "select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0"


def _queries(t):
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _library(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("j7_score_all", f"select query_id, vec_id as id, round(list_cosine_similarity(q::double[], embedding::double[]), 6) as score from ({_QV}), embeddings")
def _(t):
    return V.cosines(_queries(t), _library(t)).withColumn("score", F.round("score", 6))


_OWNER = "select l.abs_path as path, (select r.id from root r where l.abs_path like r.path || '/%' order by length(r.path) desc limit 1)::bigint as root_id from location l"


@query("j8_i13_owner_root", _OWNER)
def _(t):
    return J.owner_root(t.location.select(F.col("abs_path").alias("path")), t.root).select("path", F.col("root_id").cast("bigint").alias("root_id"))


@query("j9_merge", "select coalesce(n.asset_id, o.asset_id) as asset_id, coalesce(n.v, o.v) as v from (select asset_id, max(size) as v from location where present group by 1) o full join (select asset_id, min(size) as v from location where size % 2 = 0 group by 1) n on o.asset_id = n.asset_id")
def _(t):
    old = t.location.where("present").groupBy("asset_id").agg(F.max("size").alias("v"))
    new = t.location.where("size % 2 = 0").groupBy("asset_id").agg(F.min("size").alias("v"))
    return J.merge_keyed(old, new, "asset_id")


_STEM = r"regexp_replace(regexp_extract({}, '[^/]*$'), '\.[^.]+$', '')"


@query("j10_previews", rf"""with m as (select abs_path as p, regexp_replace(abs_path, '[^/]*$', '') as d, lower({_STEM.format('abs_path')}) as s from location where lower(abs_path) like '%.fbx'),
    i as (select concat(regexp_replace(abs_path, '[^/]*$', ''), {_STEM.format('abs_path')}, case when id % 2 = 0 then '_Thumb.PNG' else '.jpg' end) as p from location where lower(abs_path) like '%.fbx' and id % 3 = 0),
    f as (select p, regexp_replace(p, '[^/]*$', '') as d, lower({_STEM.format('p')}) as s from i)
    select m.p as model_path, min(f.p) as preview from m join f on f.d = m.d and f.s in (m.s, m.s || '_preview', m.s || '_thumb', m.s || '_thumbnail', m.s || '_icon', m.s || '-preview') group by 1""")  # fmt: skip
def _(t):
    models = t.location.where(F.lower("abs_path").endswith(".fbx"))
    images = models.where("id % 3 = 0").select(F.concat(F.regexp_replace("abs_path", r"\.[^.]+$", ""), F.when(F.col("id") % 2 == 0, "_Thumb.PNG").otherwise(".jpg")).alias("path"))
    return J.previews(models.select(F.col("abs_path").alias("path")), images)


_FACETS = "select g.name, g.namespace, count(distinct t.asset_id) as n from asset_tag t join tag g on g.id = t.tag_id where t.asset_id in (select id from asset where kind = 'image') group by all"


@query("a1_facets", f"{_FACETS} order by n desc, name limit 20")
def _(t):
    return A.facets(P.find(t, kind="image"), t, 20)


@query("a2_kind_counts", "select kind, count(*) as n from asset group by 1")
def _(t):
    return A.kind_counts(t.asset)


@query("a3_count", f"select count(*) as n from asset a where kind = 'image' and {_EXISTS_TAG.format('good')}")
def _(t):
    return P.find(t, kind="image", tags=["good"]).agg(F.count("*").alias("n"))


@query("a4_agree", """select case when count(distinct coalesce(kind, '')) = 1 then max(coalesce(kind, '')) end as kind, case when count(distinct coalesce(license, '')) = 1 then max(coalesce(license, '')) end as license,
    case when count(distinct coalesce(source_name, '')) = 1 then max(coalesce(source_name, '')) end as source_name from asset where kind = 'image' and id % 5 in (0, 1)""")  # fmt: skip
def _(t):
    return A.agree(t.asset.where("kind = 'image' and id % 5 in (0, 1)"), ["kind", "license", "source_name"])


@query("a5_selection_tags", "select g.name, count(distinct t.asset_id) as n, bool_or(t.source = 'manual') as manual from asset_tag t join tag g on g.id = t.tag_id where t.asset_id in (select id from asset where managed) group by 1 order by n desc, name limit 60")
def _(t):
    return A.selection_tags(P.find(t, is_="managed"), t)


@query("a6_collections", "select c.id, c.name, count(m.asset_id) as size from collection c left join collection_asset m on m.collection_id = c.id group by all")
def _(t):
    return A.collections(t).select("id", "name", "size")


@query("a7_root_counts", "select r.id::bigint as id, r.name, count(distinct l.asset_id) as n from root r left join location l on l.root_id = r.id and l.present group by all")
def _(t):
    return A.root_counts(t).select(F.col("id").cast("bigint").alias("id"), "name", "n")


@query("a8_pivot", "select asset_id, max(case key when 'width' then value_num end) as width, max(case key when 'height' then value_num end) as height, max(case key when 'triangles' then value_num end) as triangles from attribute where key in ('width', 'height', 'triangles') group by 1")
def _(t):
    return A.pivot_attrs(t.attribute, ["width", "height", "triangles"])


@query("a9_primary_model", "select model, count(*) as n from embedding group by 1 order by n desc, model limit 1")
def _(t):
    return A.primary_model(t.embedding)


@query("a10_overview", """with x as (select a.*, exists (select 1 from embedding e where e.asset_id = a.id and e.model = 'old') as e, exists (select 1 from location l where l.asset_id = a.id and l.present) as p from asset a)
    select count(*) as items, count(*) filter (e) as embedded, count(*) filter (kind in ('image', 'model3d') and not e and p) as outstanding, count(*) filter (caption is not null and caption <> '') as captioned,
    count(*) filter (kind <> 'reference' and not p) as missing, count(*) filter (license is not null and license <> '') as licensed from x""")  # fmt: skip
def _(t):
    return A.overview(t, "old")


@query("a11_tag_usage", "select g.id, g.name, g.namespace, count(distinct t.asset_id) as n from tag g left join asset_tag t on t.tag_id = g.id group by all")
def _(t):
    return A.tag_usage(t).select("id", "name", "namespace", "n")


_DB = "case when {0} > 0 then round(greatest(-96.0, 20 * log10({0})), 2) else -96.0 end"


@query("a12_loudness", f"with s as (select user_id as series_id, max(abs(value / 500)) as p, sqrt(avg(value / 500 * (value / 500))) as r from events group by 1) select series_id, {_DB.format('p')} as peak_db, {_DB.format('r')} as rms_db from s")
def _(t):
    return A.loudness(t.events.select(F.col("user_id").alias("series_id"), "value"), 500.0)


_SERIES = "select user_id as series_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value from events"


def _series(t):
    from pyspark.sql import Window

    return t.events.select(F.col("user_id").alias("series_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("i"), "value")


@query("a13_envelope", f"""with s as (select *, count(*) over (partition by series_id) as n from ({_SERIES})), b as (select *, least(n, 16) as k from s),
    c as (select *, (select max(x) from range(0, 16) r(x) where x < k and cast(floor(x * n / k::double) as bigint) <= i) as bucket from b)
    select series_id, bucket::bigint as bucket, greatest(-1.0, least(min(value / 480 - 0.02), 0.0)) as low, least(1.0, greatest(max(value / 480 - 0.02), 0.0)) as high,
    greatest(least(1.0, greatest(max(value / 480 - 0.02), 0.0)), -greatest(-1.0, least(min(value / 480 - 0.02), 0.0))) >= pow(10, -0.1 / 20) as clips from c group by all""")  # fmt: skip
def _(t):
    return A.envelope(_series(t).withColumn("value", F.col("value") / 480 - 0.02), 16)


@query("a14_prototypes", """with e as (select label, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as x from embeddings), m as (select label, pos, avg(x) as x from e group by all),
    n as (select label, sqrt(sum(x * x)) as s from m group by 1) select m.label, m.pos, round(m.x / n.s, 6) as x from m join n using (label)""")  # fmt: skip
def _(t):
    rows = A.prototypes(t.embeddings.select("label", F.col("embedding").alias("vector")), ["label"])
    return rows.select("label", F.posexplode("vector").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query("a15_extent", "select l_suppkey as mesh_id, round(max(l_quantity) - min(l_quantity), 4) as size_x, round(max(l_discount) - min(l_discount), 4) as size_y, round(max(l_tax) - min(l_tax), 4) as size_z, count(*) as vertices, sum(l_linenumber)::bigint as triangles from lineitem group by 1")
def _(t):
    return A.extent(t.lineitem.select(F.col("l_suppkey").alias("mesh_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.col("l_linenumber").alias("triangles")))


@query("a16_text_docs", """with f as (select asset_id, regexp_extract(abs_path, '[^/]*$') as file, min(id) as id from location group by 1, 2), g as (select asset_id, string_agg(file, ' ' order by id) as filename from f group by 1),
    w as (select asset_id, string_agg(name, ' ' order by name) as tags from (select distinct asset_id, name from named_tag) group by 1)
    select a.id, a.title, a.notes, coalesce(g.filename, '') as filename, coalesce(a.caption, '') as caption, coalesce(w.tags, '') as tags from asset a left join g on g.asset_id = a.id left join w on w.asset_id = a.id""")  # fmt: skip
def _(t):
    return A.text_docs(t)


for by, key in (("added", "added_at desc"), ("updated", "updated_at desc"), ("name", "lower(title)")):
    query(f"w1_order_{by}", f"select id, row_number() over (order by {key}, id) as rank from asset")(lambda t, by=by: W.placed(t.asset.select("id", "title", "added_at", "updated_at"), *W.sort_keys(by)).select("id", "rank"))


@query("w1_order_size", "with s as (select a.id, max(l.size) as m from asset a left join location l on l.asset_id = a.id group by 1) select id, row_number() over (order by m desc nulls last, id) as rank from s")
def _(t):
    return W.placed(W.with_size(t.asset, t.location).select("id", "max_size"), *W.sort_keys("size")).select("id", "rank")


@query("w2_primary_location", "select asset_id, id, abs_path, present from (select *, row_number() over (partition by asset_id order by present desc, id) as r from location) where r = 1")
def _(t):
    return W.primary_location(t.location).select("asset_id", "id", "abs_path", "present")


@query("w3_page", "select id, title from asset order by added_at desc, id limit 50 offset 100")
def _(t):
    return W.page(W.order(t.asset), 50, 100).select("id", "title")


_TOP = f"""with s as (select query_id, vec_id as id, list_cosine_similarity(q::double[], embedding::double[]) as c from ({_QV}), embeddings where query_id <> vec_id),
    r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from s)"""


@query("w4_top_k", f"{_TOP} select query_id, id, round(c, 6) as score, rank from r where rank <= 60 and c >= 0.1")
def _(t):
    return W.top_k(_queries(t), _library(t), 60, 0.1).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def cells(t):
    """The vectors stored by cells."""
    return V.VectorCells.store(_library(t), Catalog(t.spark, shared_folder(t.spark)))


@query("w4_cells", f"{_TOP} select query_id, id, round(c, 6) as score, rank from r where rank <= 60 and c >= 0.1")
def _(t):
    """The same neighbours, from the cells that can hold them."""
    return W.top_k(_queries(t), cells(t), 60, 0.1).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_HASH = "select vec_id as id, (select bit_or(case when embedding[i]::double > 0 then 1::bigint << (62 - i) else 0 end) from range(1, 63) r(i))::bigint as v from embeddings"


def hashes(t):
    """A 62-bit hash of each vector: the signs of its first components."""
    bits = [F.when(F.col("embedding")[i - 1] > 0, F.lit(1 << (62 - i)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(1, 63)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return t.embeddings.select(F.col("vec_id").alias("id"), out.alias("v"))


@query("w5_similar_by_hash", f"with h as ({_HASH}), s as (select q.id as query_id, h.id, bit_count(xor(q.v, h.v))::int as distance from h q, h where q.id % 100 = 0 and q.id <> h.id), r as (select *, row_number() over (partition by query_id order by distance, id) as rank from s) select query_id, id, distance, rank from r where rank <= 60 and distance <= 32")
def _(t):
    h = hashes(t)
    return W.similar_by_hash(h.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), h).select("query_id", "id", "distance", "rank")


_CODE = "select doc_id as id, (((n_chars % 64)::bigint << 40) | ((doc_id % 8)::bigint << 20) | (case lang when 'en' then 3 when 'de' then 5 else 9 end)) as v from documents"


@query("w5_dense_hashes", f"with h as ({_CODE}), s as (select q.id as query_id, h.id, bit_count(xor(q.v, h.v))::int as distance from h q, h where q.id % 100 = 0 and q.id <> h.id), r as (select *, row_number() over (partition by query_id order by distance, id) as rank from s) select query_id, id, distance, rank from r where rank <= 60 and distance <= 32")
def _(t):
    """Hashes that many rows share and few bits part: near buckets decide."""
    lang = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "de", 5).otherwise(9).cast("bigint")
    code = F.shiftleft((F.col("n_chars") % 64).cast("bigint"), 40).bitwiseOR(F.shiftleft((F.col("doc_id") % 8).cast("bigint"), 20)).bitwiseOR(lang)
    h = t.documents.select(F.col("doc_id").alias("id"), code.alias("v"))
    return W.similar_by_hash(h.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), h)


@query("f18_hamming", f"with h as ({_HASH}) select id, bit_count(xor(v, 1234567890123::bigint))::int as distance from h")
def _(t):
    return hashes(t).select("id", hamming(F.col("v"), F.lit(1234567890123)).alias("distance"))


@query("w6_append", """with n as (select l_suppkey as collection_id, l_partkey as asset_id, min(l_orderkey) as ord from lineitem where l_orderkey % 3 = 0 group by 1, 2),
    f as (select n.* from n left join collection_asset m on m.collection_id = n.collection_id and m.asset_id = n.asset_id where m.asset_id is null),
    l as (select collection_id, max(position) as last from collection_asset group by 1)
    select collection_id, asset_id, position from collection_asset union all
    select f.collection_id, f.asset_id, coalesce(l.last, -1) + row_number() over (partition by f.collection_id order by f.ord, f.asset_id) as position from f left join l on l.collection_id = f.collection_id""")  # fmt: skip
def _(t):
    new = t.lineitem.where("l_orderkey % 3 = 0").select(F.col("l_suppkey").alias("collection_id"), F.col("l_partkey").alias("asset_id"), F.col("l_orderkey").alias("ord"))
    return W.append_members(t.collection_asset, new)


@query("w7_members", "select asset_id, position from collection_asset where collection_id = 7 and asset_id % 4 <> 0")
def _(t):
    drop = t.collection_asset.where("asset_id % 4 = 0").select("collection_id", "asset_id")
    return W.remove_members(W.set_members(t, 7), drop).select("asset_id", "position")


@query("w7_containing", "select m.asset_id, c.id as collection_id, c.name from collection_asset m join collection c on c.id = m.collection_id where m.asset_id in (select id from asset where kind = 'audio')")
def _(t):
    return W.containing(t, P.find(t, kind="audio"))


@query("w8_suggest", "select g.name, count(distinct t.asset_id) as n from tag g left join asset_tag t on t.tag_id = g.id where g.name like '%th%' group by 1 order by starts_with(g.name, 'th') desc, n desc, g.name limit 12")
def _(t):
    return W.suggest(A.tag_usage(t), "th").select("name", "n")


@query("w9_by_rank", "select a.id, a.title, r.rank from (select asset_id as id, position as rank from collection_asset where collection_id = 3) r join asset a on a.id = r.id")
def _(t):
    return W.by_rank(t.asset, W.set_members(t, 3).select(F.col("asset_id").alias("id"), F.col("position").alias("rank"))).select("id", "title", "rank")


@query("w10_dominant", """with c as (select l_suppkey, l_quantity, count(*) as n from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_suppkey order by n desc, l_quantity) as k from c),
    v as (select l_suppkey, list(l_quantity order by k) as v from r where k <= 8 group by 1) select l_suppkey, array_to_string(list_transform(range(0, 8), lambda i: v[(i % len(v)) + 1]::bigint::varchar), ',') as dominant from v""")  # fmt: skip
def _(t):
    return W.dominant(t.lineitem, "l_suppkey", "l_quantity").select("l_suppkey", F.array_join(F.transform("dominant", lambda x: x.cast("bigint").cast("string")), ",").alias("dominant"))
