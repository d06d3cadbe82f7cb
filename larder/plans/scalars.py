"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions.register import register
from ..sources import files as S
from .registry import query


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _map(values: dict[str, str]) -> str:
    return f"map({_list(values)}, {_list(values.values())})"


def canonical_sql(x: str) -> str:
    """The canonical form without lookarounds."""
    camel = f"regexp_replace(regexp_replace(trim({x}), '([a-z])([A-Z])', '\\1-\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1-\\2', 'g')"
    flat = f"trim(regexp_replace(lower({camel}), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce({_map(T.ALIASES)}[{flat}], {flat})"


def words_sql(x: str) -> str:
    cut = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    each = f"list_transform(string_split_regex({cut}, '[^A-Za-z0-9]+'), lambda w: regexp_replace({canonical_sql('w')}, '[0-9]+$', ''))"
    kept = f"list_filter({each}, lambda w: length(w) >= 2 and not list_contains({_list(T.NOISE)}, w) and not regexp_matches(w, '^v[0-9]+$'))"
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


_NAMES = "select o_orderkey as id, concat(case o_orderkey % 7 when 0 then ' UIIcon' when 1 then 'PixelArt' when 2 then 'normalMap' when 3 then 'style:LowPoly' when 4 then 'dark:elf' when 5 then 'source: My Pack' else 'bg' end, case o_orderkey % 3 when 0 then '' when 1 then cast(o_orderkey % 50 as {text}) else concat('_', lower(o_orderpriority)) end) as name from {orders}"


def _names(t):
    return t.spark.sql(_NAMES.replace("{text}", "string"), orders=t.orders)


_NAMES_SQL = _NAMES.replace("{text}", "varchar").replace("{orders}", "orders")


@query("f1_canonical", f"select id, {canonical_sql('name')} as tag from ({_NAMES_SQL})")
def _(t):
    return _names(t).select("id", T.canonical("name").alias("tag"))


_NS = _map({x: n for n, xs in T.VOCABULARY.items() for x in xs})
_HEAD, _TAIL = canonical_sql("split_part(name, ':', 1)"), "regexp_replace(name, '^[^:]*:', '')"
_PREFIXED = f"(contains(name, ':') and list_contains({_list(T.NAMESPACES)}, {_HEAD}) and trim({_TAIL}) <> '')"


@query("f2_resolve", f"select id, case when {_PREFIXED} then {canonical_sql(_TAIL)} else {canonical_sql('name')} end as tag, case when {_PREFIXED} then {_HEAD} else {_NS}[{canonical_sql('name')}] end as namespace from ({_NAMES_SQL})")
def _(t):
    return _names(t).select("id", T.resolve("name").alias("r")).select("id", "r.tag", "r.namespace")


_STEM = r"regexp_replace(regexp_extract(abs_path, '[^/]*$'), '\.[^.]+$', '')"


@query("f3_name_words", f"select id, array_to_string({words_sql(_STEM)}, ' ') as words from location")
def _(t):
    return t.location.select("id", F.array_join(T.name_words(F.regexp_extract("abs_path", "[^/]*$", 0)), " ").alias("words"))


@query("f4_title_tags", f"select item_id, array_to_string(list_slice({words_sql('text')}, 1, 6), ' ') as tags from benchmark")
def _(t):
    return t.benchmark.select("item_id", F.array_join(T.title_tags("text"), " ").alias("tags"))


_FOLDERS = f"list_filter(list_transform(list_reverse(list_slice(string_split(substring(abs_path, length(r.path) + 2), '/'), 1, -2)), lambda w: {canonical_sql('w')}), lambda w: w <> '' and not list_contains({_list(T.NOISE_FOLDERS)}, w))"


@query("f5_folder_tags", f"select l.id, array_to_string(list_slice({_FOLDERS}, 1, 2), ' ') as tags from location l join root r on r.id = l.root_id")
def _(t):
    rows = t.location.join(t.root.select(F.col("id").alias("root_id"), "path"), "root_id")
    return rows.select("id", F.array_join(T.folder_tags("abs_path", "path"), " ").alias("tags"))


_PARTS = "list_filter(string_split(url, '/'), lambda w: w <> '')"
_NAMED = f"list_filter({_PARTS}, lambda w: not list_contains({_list(T.GENERIC_FOLDERS)}, lower(w)))"


@query("f6_root_label", f"select page_id, coalesce({canonical_sql(f'{_NAMED}[-1]')}, {canonical_sql(f'{_PARTS}[-1]')}, 'root') as label from pages")
def _(t):
    return t.pages.select("page_id", T.root_label("url").alias("label"))


_AMOUNT = "select event_id, concat(case when event_id % 11 = 0 then '-' else '' end, cast(event_id % 1000 as {text}), case when event_id % 13 = 0 then '.5' else '' end, case event_id % 9 when 0 then 'mb' when 1 then ' KB' when 2 then 'kbps' when 3 then 'db' when 4 then 'ms' when 5 then 's' when 6 then 'khz' when 7 then '' else ' miles' end) as q from {events}"
_UNIT = "map(" + _list(N.UNITS) + ", [" + ", ".join(f"{v!r}::double" for v in N.UNITS.values()) + "])"


@query("f7_quantity", f"select event_id, try_cast(regexp_extract(trim(q), '^(-?[0-9]*\\.?[0-9]+)\\s*([A-Za-z]*)$', 1) as double) * {_UNIT}[lower(regexp_extract(trim(q), '^(-?[0-9]*\\.?[0-9]+)\\s*([A-Za-z]*)$', 2))] as amount from ({_AMOUNT.replace('{text}', 'varchar').replace('{events}', 'events')})")
def _(t):
    return t.spark.sql(_AMOUNT.replace("{text}", "string"), events=t.events).select("event_id", N.quantity("q").alias("amount"))


_RAW = "select page_id, case page_id % 6 when 0 then upper(url) when 1 then regexp_replace(url, '^https?://', '') when 2 then concat('  ', url) when 3 then concat('ftp://', url) when 4 then 'not a url' else regexp_replace(url, '^(https?://)', concat('{one}', 'user@www.')) end as url from {pages}"


def _raw(t):
    return t.spark.sql(_RAW.replace("{one}", "$1").replace("{pages}", "{pages}"), pages=t.pages)


_RAW_SQL = _RAW.replace("{one}", "\\1").replace("{pages}", "pages")
_U = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)"


def url_sql(x: str) -> str:
    explicit = f"regexp_matches(trim({x}), '^[A-Za-z][A-Za-z0-9+.-]*:')"
    full = f"case when {explicit} then trim({x}) else 'https://' || trim({x}) end"
    net = f"lower(regexp_extract({full}, '{_U}', 2))"
    host = f"regexp_replace(regexp_replace({net}, '^.*@', ''), ':[0-9]*$', '')"
    return f"case when lower(regexp_extract({full}, '{_U}', 1)) in ('http', 'https') and regexp_matches({host}, '^[\\p{{L}}\\p{{N}}]([\\p{{L}}\\p{{N}}_.-]*[\\p{{L}}\\p{{N}}])?$') and ({explicit} or contains({host}, '.')) then lower(regexp_extract({full}, '{_U}', 1)) || '://' || {net} || regexp_extract({full}, '{_U}', 3) end"


def host_sql(x: str) -> str:
    return f"regexp_replace(split_part(regexp_replace(lower(regexp_extract({x}, '{_U}', 2)), '^.*@', ''), ':', 1), '^www\\.', '')"


def slug_sql(x: str) -> str:
    last = f"list_filter(string_split(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)', 1), '/'), lambda w: w <> '' and w <> '.')[-1]"
    return f"coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace({last}, '(.)\\.[^.]+$', '\\1'), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')), ''), {host_sql(x)})"


@query("f8_normalise_url", f"select page_id, {url_sql('url')} as url from ({_RAW_SQL})")
def _(t):
    return _raw(t).select("page_id", T.normalise_url("url").alias("url"))


@query("f9_host", f"select page_id, {host_sql('url')} as host from ({_RAW_SQL})")
def _(t):
    return _raw(t).select("page_id", T.host_of("url").alias("host"))


@query("f10_slug_title", f"select page_id, {slug_sql('url')} as title from pages")
def _(t):
    return t.pages.select("page_id", T.slug_title("url").alias("title"))


@query("f11_collapse", "select doc_id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 500) as line from documents")
def _(t):
    return t.documents.select("doc_id", T.collapse("text").alias("line"))


@query("f12_link_key", f"select page_id, substring(sha256('link:' || {url_sql('url')}), 1, 32) as key from ({_RAW_SQL})")
def _(t):
    return _raw(t).select("page_id", T.link_key("url").alias("key"))


_TIDY = r"regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(the |this )?(image|picture|photo|illustration|artwork|sprite|asset)?\s*(shows|depicts|features|displays|is|contains|presents)\s+', '', 'i')"
_KEPT = rf"substring(trim(array_to_string(list_slice(string_split(regexp_replace({_TIDY}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1, 2), ' ')), 1, 300)"


@query("f13_tidy", f"with x as (select conv_id, turn, {_KEPT} as kept from (select conv_id, turn, case when conv_id % 3 = 0 then 'The image  shows ' || lower(text) else text end as text from conversations)) select conv_id, turn, upper(substring(kept, 1, 1)) || substring(kept, 2) as caption from x")
def _(t):
    rows = t.conversations.withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("The image  shows "), F.lower("text"))).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", T.tidy("text").alias("caption"))


_FILE = "concat(case o_orderkey % 4 when 0 then 'tile-' when 1 then 'a.b-' when 2 then 'x' else 'no-ext-' end, cast(o_orderkey as {text}), case o_orderkey % 4 when 3 then '' else '.png' end)"


@query("f14_next_name", f"""with f as (select o_orderkey as id, {_FILE.format(text='varchar')} as name from orders), b as (select id, name, case when regexp_matches(name, '^.+\\.[^.]*$') then regexp_replace(name, '\\.[^.]*$', '') else name end as base from f)
    select id, case when regexp_matches(base, '-[0-9]+$') then regexp_replace(base, '[0-9]+$', '') || (regexp_extract(base, '-([0-9]+)$', 1)::bigint + 1)::varchar else base || '-1' end || substring(name, length(base) + 1) as next from b""")  # fmt: skip
def _(t):
    rows = t.spark.sql(f"select o_orderkey as id, {_FILE.format(text='string')} as name from {{orders}}", orders=t.orders)
    return rows.select("id", T.next_name("name").alias("next"))


@query("f15_to_db", "select event_id, case when value > 100 then round(greatest(-96.0, 20 * log10((value - 100) / 400)), 2) else -96.0 end as db from events")
def _(t):
    return t.events.select("event_id", N.to_db((F.col("value") - 100) / 400).alias("db"))


@query("f16_first_positive", "select l_orderkey, l_linenumber, coalesce(nullif(l_tax, 0), nullif(l_discount, 0)) as first from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", N.first_positive("l_tax", "l_discount").alias("first"))


_W = "case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else cast({0} as varchar) end"


@query("f17_shape", f"""with v as (select asset_id, max(case key when 'width' then value_num end) as w, max(case key when 'height' then value_num end) as h, max(case key when 'triangles' then value_num end) as t, max(case key when 'duration' then value_num end) as d,
    max(case key when 'channels' then value_num end) as c, max(case key when 'peak_db' then value_num end) as p, max(case key when 'host' then value_text end) as host from attribute group by 1)
    select a.id, coalesce(case a.kind when 'reference' then v.host when 'image' then {_W.format('v.w')} || 'x' || {_W.format('v.h')} when 'model3d' then {_W.format('v.t')} || ' tris'
    when 'audio' then printf('%.1f', v.d) || 's ' || case v.c when 1 then 'mono' else 'stereo' end || ' ' || round_even(v.p, 0)::bigint::varchar || 'dB' end, '') as shape from asset a left join v on v.asset_id = a.id""")  # fmt: skip
def _(t):
    facts = t.attribute.groupBy("asset_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("value_num").isNotNull(), F.struct("key", "value_num")))).alias("v"), F.max(F.when(F.col("key") == "host", F.col("value_text"))).alias("host"))
    return t.asset.join(facts.withColumnRenamed("asset_id", "id"), "id", "left").select("id", N.shape(F.col("kind"), F.col("v"), F.col("host")).alias("shape"))


@query("f19_l2", "select vec_id, unnest(range(1, len(embedding) + 1)) as pos, round(unnest(list_transform(embedding, lambda x: (x::double * 3) / sqrt(list_sum(list_transform(embedding, lambda y: (y::double * 3) * (y::double * 3)))))), 6) as x from embeddings")
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    return t.embeddings.select("vec_id", F.posexplode(N.l2(v)).alias("pos", "x")).select("vec_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query("f20_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, "vec_id").select("vec_id", F.round(N.cosine("embedding", "other"), 6).alias("cosine"))


@query("f21_duration_tag", "select event_id, case when value / 10 <= 2 then 'sfx' when value / 10 >= 30 then 'music' end as tag from events")
def _(t):
    return t.events.select("event_id", N.duration_tag(F.col("value") / 10).alias("tag"))


@query("f22_geometry_tags", "select p_partkey, array_to_string(list_filter([case when p_size % 3 > 0 then 'rigged' end, case when p_size % 2 > 0 then 'animation' end, case when p_retailprice * 2 > 0 and p_retailprice * 2 <= 2000 then 'low-poly' end], lambda x: x is not null), ' ') as tags from part")
def _(t):
    return t.part.select("p_partkey", F.array_join(N.geometry_tags(F.col("p_retailprice") * 2, F.col("p_size") % 3, F.col("p_size") % 2), " ").alias("tags"))


@query("f23_rendition", """with s as (select p_partkey, p_size * 40 as w, 16 + p_partkey % 1500 as h, p_partkey % 500 as c from part), f as (select *, greatest(w, h) as e from s)
    select p_partkey, e <= 256 as skip, case when e <= 256 then w else greatest(1, round_even(w * 256 / e::double, 0)) end::bigint as width, case when e <= 256 then h else greatest(1, round_even(h * 256 / e::double, 0)) end::bigint as height,
    case when e <= 256 then 'none' when abs(e / 256.0 - round_even(e / 256.0, 0)) < 0.01 and round_even(e / 256.0, 0) > 1 then 'nearest' else 'lanczos' end as method, c <= 256 as lossless from f""")  # fmt: skip
def _(t):
    return t.part.select("p_partkey", N.rendition(F.col("p_size") * 40, 16 + F.col("p_partkey") % 1500, F.col("p_partkey") % 500).alias("r")).select("p_partkey", "r.*")


_JSON = """concat('{"streams":[', case when event_id % 5 = 0 then '' else '{"codec_type":"video"},' end, case when event_id % 7 = 0 then '{"codec_type":"data"}' else concat('{"codec_type":"audio","codec_name":"vorbis","sample_rate":"44100","channels":', cast(1 + event_id % 2 as TEXT), ',"bits_per_sample":', cast(event_id % 3 * 8 as TEXT), case when event_id % 2 = 0 then ',"duration":"2.5004"' else '' end, '}') end, '],"format":{"duration":"', cast(event_id % 90 as TEXT), '.25","bit_rate":"192000"}}')"""


@query("f24_media_json", f"""with j as (select event_id, json_extract({_JSON.replace('TEXT', 'varchar')}, '$') as doc from events), s as (select event_id, doc, list_filter(from_json(doc->'streams', '["json"]'), lambda x: x->>'codec_type' = 'audio')[1] as s from j)
    select event_id, case when s is not null then round(coalesce((s->>'duration')::double, (doc->'format'->>'duration')::double), 3) end as duration, (s->>'sample_rate')::bigint as sample_rate, (s->>'channels')::bigint as channels, nullif((s->>'bits_per_sample')::bigint, 0) as bit_depth,
    case when s is not null then (doc->'format'->>'bit_rate')::bigint end as bitrate, s->>'codec_name' as codec, case when s is null then 'no audio stream' end as error from s""")  # fmt: skip
def _(t):
    rows = t.spark.sql(f"select event_id, {_JSON.replace('TEXT', 'string').replace('{', '{{').replace('}', '}}')} as doc from {{events}}", events=t.events)
    return rows.select("event_id", N.media_facts("doc").alias("f")).select("event_id", "f.*")


@query("s2_kind", """select id, case when lower(regexp_extract(abs_path, '\\.([A-Za-z0-9]+)$', 1)) = 'png' then 'image' when lower(regexp_extract(abs_path, '\\.([A-Za-z0-9]+)$', 1)) = 'fbx' then 'model3d' else 'audio' end as kind
    from location where lower(regexp_extract(abs_path, '\\.([A-Za-z0-9]+)$', 1)) in ('png', 'fbx', 'wav')""")  # fmt: skip
def _(t):
    return S.with_kind(t.location, "abs_path").select("id", "kind")


@query("s3_exclude", "select id from location where not (abs_path like '/lib/urgent/Paving/%' or regexp_matches(abs_path, '/(HUD[^/]*)(/|$)') or regexp_matches(abs_path, '[^/]*[13]\\.wav(/|$)') or regexp_matches(abs_path, 'Quay_[^/]v[^/]*') or regexp_matches(abs_path, '/NightBoats/([^/]+/)*ferry[^/]*$'))")
def _(t):
    rows = t.location.withColumn("rel", F.substr("abs_path", F.lit(2)))
    return S.exclude(rows, ["lib/urgent/Paving/**", "HUD*", "*[13].wav", "Quay_[!/]v*", "**/NightBoats/**/ferry*"]).select("id")


@query("s5_content_key", "select doc_id, substring(sha256(text), 1, 32) as key from documents")
def _(t):
    return t.documents.select("doc_id", T.content_key("text").alias("key"))


@query("s6_shard_path", "select id, substring(content_hash, 1, 2) || '/' || substring(content_hash, 3, 2) || '/' || content_hash || '.webp' as path from asset")
def _(t):
    return t.asset.select("id", T.shard_path("content_hash").alias("path"))


@query("s9_links", f"with u as (select distinct {url_sql('url')} as url from ({_RAW_SQL})) select url, {slug_sql('url')} as title, {host_sql('url')} as site_name from u where url is not null")
def _(t):
    return S.links(_raw(t), "url")


_SAFE = r"regexp_replace(regexp_replace(name, '\\', '/', 'g'), '^(/+|[A-Za-z]:(/+|$))+', '')"
_SAFE_PARTS = f"list_filter(string_split({_SAFE}, '/'), lambda w: w <> '' and w <> '.' and w <> '..')"
_MEMBER = "concat(case o_orderkey % 8 when 0 then '../../' when 1 then '/etc/' when 2 then 'D:/Data/' when 3 then '{b}srv{b}' when 4 then '.cache/' when 5 then './k/../m/' when 6 then '/E:/q/' else 'Box/Inner/' end, '.f', cast(o_orderkey as {text}), '.png')"


@query("i18_safe_relative", f"with m as (select o_orderkey as id, {_MEMBER.replace('{b}', chr(92)).replace('{text}', 'varchar')} as name from orders) select id, array_to_string(list_transform({_SAFE_PARTS}, lambda w: coalesce(nullif(regexp_replace(w, '^\\.+', ''), ''), '_')), '/') as path from m")
def _(t):
    rows = t.spark.sql(f"select o_orderkey as id, {_MEMBER.replace('{b}', chr(92) * 2).replace('{text}', 'string')} as name from {{orders}}", orders=t.orders)
    return rows.select("id", T.safe_relative("name").alias("path"))


@query("v4_sql_functions", "select event_id, case when value > 0 then round(greatest(-96.0, 20 * log10(value / 500)), 2) else -96.0 end as db, case when value <= 2 then 'sfx' when value >= 30 then 'music' end as tag, bit_count(xor(event_id, user_id))::int as bits from events")
def _(t):
    register(t.spark)
    return t.events.selectExpr("event_id", "to_db(value / 500) as db", "duration_tag(value) as tag", "hamming(event_id, user_id) as bits")
