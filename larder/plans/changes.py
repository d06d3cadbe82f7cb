"""Queries of sync, edits, transfers, links and backlogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backlog as B
from ..operators import filters as P
from ..operators import links as L
from ..operators import sets as U
from ..operators import sync as I
from ..operators import transfer as X
from ..sources.files import links as address_lines
from .registry import query
from .scalars import _RAW_SQL, _U, _raw, canonical_sql, host_sql, slug_sql, url_sql

_KEYED = "substring(sha256(o_orderstatus || (round(o_totalprice * {f}))::bigint::varchar), 1, 32)"
#: Two snapshots from orders: before lacks every tenth row; now lacks the first of ten and has a changed price for the second.
_SNAP = f"""old as (select o_orderkey as id, '/lib/' || o_orderkey as abs_path, {_KEYED.format(f='1')} as content_hash, o_custkey % 5 + 1 as root_id, (o_totalprice * 100)::bigint as size, o_orderdate as mtime, o_orderkey % 17 <> 0 as present from orders where o_orderkey % 10 <> 0),
    now as (select o_orderkey as id, '/lib/' || o_orderkey as path, {_KEYED.format(f='case when o_orderkey % 10 = 2 then 2 else 1 end')} as content_hash, o_custkey % 5 + 1 as root_id, ((case when o_orderkey % 10 = 2 then 2 else 1 end) * o_totalprice * 100)::bigint as size, o_orderdate as mtime from orders where o_orderkey % 10 <> 1),
    items as (select content_hash, min(id) as id from old group by 1), places as (select o.*, i.id as asset_id from old o join items i on i.content_hash = o.content_hash)"""


def _snap(t):
    """items (id, content_hash), places (locations before), files (the listing now)."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice", "o_orderdate", (F.col("o_custkey") % 5 + 1).alias("root_id"))
    key = lambda f: F.substring(F.sha2(F.concat("o_orderstatus", F.round(F.col("o_totalprice") * f).cast("bigint").cast("string")).cast("binary"), 256), 1, 32)
    twice = F.when(F.col("id") % 10 == 2, 2).otherwise(1)
    size = lambda f: F.round(f * F.col("o_totalprice") * 100).cast("bigint")
    path = F.concat(F.lit("/lib/"), F.col("id").cast("string"))
    old = rows.where("id % 10 <> 0").select("id", path.alias("abs_path"), key(F.lit(1)).alias("content_hash"), "root_id", size(F.lit(1)).alias("size"), F.col("o_orderdate").alias("mtime"), (F.col("id") % 17 != 0).alias("present"))
    now = rows.where("id % 10 <> 1").select("id", path.alias("path"), key(twice).alias("content_hash"), "root_id", size(twice).alias("size"), F.col("o_orderdate").alias("mtime"))
    items = old.groupBy("content_hash").agg(F.min("id").alias("id"))
    places = old.join(items.select("content_hash", F.col("id").alias("asset_id")), "content_hash").withColumn("last_seen", F.col("mtime"))
    return items, places, now


@query("i1_needs_hash", f"with {_SNAP} select n.path from now n left join old o on o.abs_path = n.path and o.size = n.size and o.mtime = n.mtime where o.id is null")
def _(t):
    _, places, now = _snap(t)
    return I.needs_hash(now, places).select("path")


_CLASS = f"{_SNAP}, cls as (select n.*, i.id as asset_id, case when i.id is null then 'added' when p.abs_path is null then 'relinked' when p.asset_id <> i.id then 'updated' else 'unchanged' end as status from now n left join items i on i.content_hash = n.content_hash left join places p on p.abs_path = n.path)"


@query("i2_classify", f"with {_CLASS} select path, asset_id, status from cls")
def _(t):
    items, places, now = _snap(t)
    return I.classify(now, items, places).select("path", "asset_id", "status")


@query("i3_new_assets", f"with {_SNAP}, f as (select n.content_hash, min(n.path) as title from now n left join items i on i.content_hash = n.content_hash where i.id is null group by 1) select (select max(id) from items) + row_number() over (order by content_hash) as id, content_hash, title from f")
def _(t):
    items, _, now = _snap(t)
    listing = now.withColumns({"kind": F.lit("image"), "title": F.col("path"), "mode": F.lit("indexed")})
    return I.new_assets(listing, items).select("id", "content_hash", "title")


_SEEN = "cls as (select n.*, coalesce(i.id, 0) as asset_id from now n left join items i on i.content_hash = n.content_hash)"
_STAMP = "timestamp '2030-01-01'"


def _upserted(t):
    items, places, now = _snap(t)
    seen = I.classify(now, items, places).select(F.col("path").alias("abs_path"), F.coalesce("asset_id", F.lit(0)).cast("bigint").alias("asset_id"), "root_id", "size", "mtime")
    return I.upsert_locations(places, seen, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


@query("i4_upsert_locations", f"with {_SNAP}, {_SEEN} select coalesce(n.path, p.abs_path) as abs_path, coalesce(n.asset_id, p.asset_id) as asset_id, coalesce(n.size, p.size) as size, case when n.path is not null then {_STAMP} else p.mtime end as last_seen, coalesce(n.path is not null, false) or p.present as present from places p full join cls n on n.path = p.abs_path")
def _(t):
    return _upserted(t).select("abs_path", "asset_id", "size", "last_seen", "present")


@query("i5_mark_absent", f"with {_SNAP} select coalesce(n.path, p.abs_path) as abs_path, n.path is not null or (p.present and p.root_id not in (1, 2, 3)) as present from places p full join now n on n.path = p.abs_path")
def _(t):
    roots = t.root.where("id <= 3").select("id")
    return I.mark_absent(_upserted(t), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), roots).select("abs_path", "present")


@query("i6_returned", f"with {_SNAP} select p.abs_path from places p join now n on n.path = p.abs_path where not p.present")
def _(t):
    _, places, _ = _snap(t)
    return _upserted(t).where("present").join(places.where("not present").select("abs_path"), "abs_path", "left_semi").select("abs_path")


@query("i7_sync_stats", f"with {_CLASS} select root_id, count(*) as seen, count(*) filter (status = 'added') as added, count(*) filter (status = 'relinked') as relinked, count(*) filter (status = 'updated') as updated, count(*) filter (status = 'unchanged') as unchanged, count(*) filter (size % 2 = 0) as hashed, count(*) filter (size % 97 = 0) as errors from cls group by 1")
def _(t):
    items, places, now = _snap(t)
    rows = I.classify(now, items, places).withColumns({"hashed": F.col("size") % 2 == 0, "error": F.when(F.col("size") % 97 == 0, "bad")})
    return I.sync_stats(rows)


@query("i8_sync_roots", "with c as (select n_nationkey as id, concat('/lib/', n_name) as path, n_name as name, 'managed' as mode, true as recursive, false as vendor, n_nationkey % 2 = 0 as enabled from nation), o as (select n_nationkey as id, concat(case when n_nationkey % 3 = 0 then '/old/' else '/lib/' end, n_name) as path, lower(n_name) as name, 'indexed' as mode, false as recursive, true as vendor from nation) select o.id, coalesce(c.path, o.path) as path, coalesce(c.name, o.name) as name, coalesce(c.mode, o.mode) as mode, coalesce(c.recursive, o.recursive) as recursive, coalesce(c.vendor, o.vendor) as vendor, coalesce(c.enabled, false) as enabled from o full join c on c.path = o.path")
def _(t):
    path = F.concat(F.lit("/lib/"), "n_name").alias("path")
    config = t.nation.select(path, F.col("n_name").alias("name"), F.lit("managed").alias("mode"), F.lit(True).alias("recursive"), F.lit(False).alias("vendor"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    was = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "/old/").otherwise("/lib/"), "n_name").alias("path")  # a third has moved
    old = t.nation.select(F.col("n_nationkey").alias("id"), was, F.lower("n_name").alias("name"), F.lit("indexed").alias("mode"), F.lit(False).alias("recursive"), F.lit(True).alias("vendor"))
    return I.sync_roots(old, config)


_MISSING = "select id from asset a where kind <> 'reference' and not exists (select 1 from location l where l.asset_id = a.id and l.present)"


@query("i9_missing", _MISSING)
def _(t):
    return P.missing(t.asset, t.location).select("id")


@query("i10_prune", f"with gone as ({_MISSING}) select 'asset' as name, count(*) as n from asset where id not in (select id from gone) union all select 'asset_tag', count(*) from asset_tag where asset_id not in (select id from gone) union all select 'attribute', count(*) from attribute where asset_id not in (select id from gone) union all select 'embedding', count(*) from embedding where asset_id not in (select id from gone) union all select 'collection_asset', count(*) from collection_asset where asset_id not in (select id from gone) union all select 'location', count(*) from location where asset_id not in (select id from gone)")
def _(t):
    out = None
    for name, rows in I.prune(t, dry_run=False).items():
        one = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("i11_reprobe", "with seen as (select id as asset_id from asset where id % 3 = 0), tags as (select id as asset_id, 'new-tag' as name, 'heuristic' as source, 0.4::double as confidence from asset) select asset_id, name, source, max(confidence) as confidence from (select asset_id, name, source, confidence from named_tag where not (source in ('structural', 'heuristic', 'clip', 'vlm') and asset_id in (select asset_id from seen)) union all select * from tags where asset_id in (select asset_id from seen)) group by all")
def _(t):
    seen = t.asset.where("id % 3 = 0").select(F.col("id").alias("asset_id"))
    tags = t.asset.select(F.col("id").alias("asset_id"), F.lit("new-tag").alias("name"), F.lit("heuristic").alias("source"), F.lit(0.4).alias("confidence"))
    return I.reprobe(t.named_tag, t.attribute, seen, t.attribute, tags)[0]


@query("i12_to_attributes", "select p_partkey as asset_id, 'name' as key, p_name as value_text, null::double as value_num from part where p_name is not null union all select p_partkey, 'size', null, p_size::double from part union all select p_partkey, 'cheap', null, (p_retailprice < 1000)::int::double from part union all select p_partkey, 'odd', 'odd', null from part where p_size % 2 = 1")
def _(t):
    wide = t.part.select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_retailprice") < 1000).alias("cheap"), F.when(F.col("p_size") % 2 == 1, "odd").alias("odd"))
    return I.to_attributes(wide)


_OLDLINK = f"select substring(sha256('link:' || {url_sql('url')}), 1, 32) as key, {url_sql('url')} as url, case when page_id % 2 = 0 then ' ' else 'Kept' end as title, case when page_id % 4 = 0 then null else 'note' end as notes, '' as source_name, case when page_id % 8 = 0 then 'CC0' end as license from pages where page_id % 3 <> 0"
_NEWLINK = f"select substring(sha256('link:' || {url_sql('url')}), 1, 32) as key, min({url_sql('url')}) as url, max({slug_sql('url')}) as title, max('desc') as notes, max({host_sql('url')}) as source_name, max('MIT') as license, max(case when page_id % 5 = 0 then 'By hand' end) as given from pages where page_id % 3 <> 1 and {url_sql('url')} is not null group by 1"


@query("i14_merge_links", f"with o0 as ({_OLDLINK}), o as (select key, min(url) as url, max(title) as title, max(notes) as notes, max(source_name) as source_name, max(license) as license from o0 where key is not null group by 1), n as ({_NEWLINK}) select coalesce(o.key, n.key) as key, coalesce(o.url, n.url) as url, coalesce(nullif(trim(n.given), ''), nullif(trim(o.title), ''), nullif(trim(n.title), '')) as title, coalesce(nullif(trim(o.notes), ''), nullif(trim(n.notes), '')) as notes, coalesce(nullif(trim(o.source_name), ''), nullif(trim(n.source_name), '')) as source_name, coalesce(nullif(trim(o.license), ''), nullif(trim(n.license), '')) as license from o full join n on n.key = o.key")
def _(t):
    from ..functions.text import host_of, link_key, normalise_url, slug_title

    old = t.pages.where("page_id % 3 <> 0").select(link_key("url").alias("key"), normalise_url("url").alias("url"), F.when(F.col("page_id") % 2 == 0, " ").otherwise("Kept").alias("title"), F.when(F.col("page_id") % 4 != 0, "note").alias("notes"), F.lit("").alias("source_name"), F.when(F.col("page_id") % 8 == 0, "CC0").alias("license"))
    old = old.where("key is not null").groupBy("key").agg(F.min("url").alias("url"), *[F.max(c).alias(c) for c in ("title", "notes", "source_name", "license")])
    new = t.pages.where("page_id % 3 <> 1").select("url", slug_title("url").alias("title"), F.lit("desc").alias("description"), host_of("url").alias("site_name"), F.lit("MIT").alias("license"), F.when(F.col("page_id") % 5 == 0, "By hand").alias("given_title"))
    return L.merge_links(old, new)


@query("i15_plan_import", """with known as (select a.content_hash, a.id from asset a where exists (select 1 from location l where l.asset_id = a.id and l.present)), inc as (select doc_id, concat('/in/', doc_id, case doc_id % 4 when 0 then '.cs' else '.png' end) as path, substring(sha256(case when doc_id % 2 = 0 then text else text || 'x' end), 1, 32) as content_hash from documents)
    select i.path, k.id as duplicate_of, case when i.doc_id % 4 = 0 then 'skipped' when k.id is not null then 'duplicate' else 'imported' end as action from inc i left join known k on k.content_hash = i.content_hash""")  # fmt: skip
def _(t):
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".cs").otherwise(".png"))
    text = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))
    incoming = t.documents.select(path.alias("path"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("content_hash"))
    return X.plan_import(incoming, t.asset, t.location).select("path", "duplicate_of", "action")


_LIST = "select l_suppkey as archive, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) as ord, concat(case l_orderkey % 9 when 0 then '../' when 1 then 'C:/' when 2 then '__MACOSX/' when 3 then '.git/' else 'Pack/' end, cast(l_partkey as {text}), case l_linenumber % 4 when 0 then '.zip' when 1 then '.txt' else '.png' end) as name, cast(l_extendedprice * 2000 as bigint) * case when l_linenumber = 6 then 10 else 1 end as size, l_orderkey % 11 = 0 as is_dir from {lineitem}"


def _listing(t):
    return t.spark.sql(_LIST.replace("{text}", "string").replace("cast(l_extendedprice * 2000 as bigint)", "cast(round(l_extendedprice * 2000) as bigint)"), lineitem=t.lineitem)


_LIST_SQL = _LIST.replace("{text}", "varchar").replace("{lineitem}", "lineitem").replace("cast(l_extendedprice * 2000 as bigint)", "cast(round(l_extendedprice * 2000) as bigint)")
_VERDICT = f"""raw as ({_LIST_SQL}), first as (select *, name as relative, case when regexp_matches(name, '^(/|[A-Za-z]:)') or name like '../%' then 'unsafe path' when name like '.git/%' or name like '__MACOSX/%' then 'hidden' when name like '%.zip' then 'nested archive' when name not like '%.png' then 'unknown' when size > 536870912 then 'too large' else 'ok' end as v from raw where not is_dir),
    run as (select *, sum(case when v = 'ok' then size else 0 end) over (partition by archive order by ord rows unbounded preceding) as total from first), verdicts as (select archive, ord, relative, size, case when total > 8589934592 then 'beyond the limit' else v end as verdict from run)"""


@query("i16_w11_filter_members", f"with {_VERDICT} select archive, ord, relative, verdict from verdicts")
def _(t):
    return X.filter_members(_listing(t)).select("archive", F.col("ord").cast("bigint").alias("ord"), "relative", "verdict")


@query("i17_strip_shared_folder", "with m as (select l_suppkey as archive, l_orderkey as ord, case when l_suppkey % 3 = 0 then concat('Pack/', l_partkey) when l_suppkey % 3 = 1 then concat('P', l_partkey % 2, '/', l_partkey) else concat('Pack/', case when l_linenumber = 1 then '' else 'a/' end, l_partkey) end as relative, l_linenumber from lineitem), s as (select archive, count(distinct split_part(relative, '/', 1)) = 1 and bool_and(contains(relative, '/')) as strip from m group by 1) select archive, ord, l_linenumber, case when strip then regexp_replace(relative, '^[^/]*/', '') else relative end as relative from m join s using (archive)")
def _(t):
    part = F.col("l_partkey").cast("string")
    rel = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("Pack/"), part)).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("P"), (F.col("l_partkey") % 2).cast("string"), F.lit("/"), part)).otherwise(F.concat(F.lit("Pack/"), F.when(F.col("l_linenumber") == 1, "").otherwise("a/"), part))
    return X.strip_shared_folder(t.lineitem.select(F.col("l_suppkey").alias("archive"), F.col("l_orderkey").alias("ord"), "l_linenumber", rel.alias("relative")))


@query("i19_batch_label", f"with f as (select p_partkey, concat('/in/', p_name, case p_partkey % 3 when 0 then '.zip' when 1 then '.png' else '' end) as path, p_partkey % 3 = 2 as is_dir, p_name from part) select p_partkey, case when p_partkey % 3 = 1 then 'dropped' else coalesce(nullif({canonical_sql('p_name')}, ''), 'dropped') end as batch from f")
def _(t):
    path = F.concat(F.lit("/in/"), "p_name", F.when(F.col("p_partkey") % 3 == 0, ".zip").when(F.col("p_partkey") % 3 == 1, ".png").otherwise(""))
    return t.part.select("p_partkey", X.batch_label(path, F.col("p_partkey") % 3 == 2).alias("batch"))


@query("i20_resolve_names", """with r as (select (o_custkey % 50)::varchar as folder, concat('tile', o_orderkey % 7, '.png') as name, (o_orderkey % 11)::varchar as content_hash, o_orderkey as ord from orders), f as (select folder, name, content_hash, min(ord) as first from r group by all), d as (select *, dense_rank() over (partition by folder, name order by first) as k from f)
    select r.folder, r.ord, case when d.k = 1 then r.name else regexp_replace(r.name, '\\.png$', '') || '-' || (d.k - 1) || '.png' end as target, r.ord = d.first as fresh from r join d on d.folder = r.folder and d.name = r.name and d.content_hash = r.content_hash""")  # fmt: skip
def _(t):
    rows = t.orders.select((F.col("o_custkey") % 50).cast("string").alias("folder"), F.concat(F.lit("tile"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".png")).alias("name"), (F.col("o_orderkey") % 11).cast("string").alias("content_hash"), F.col("o_orderkey").alias("ord"))
    return X.resolve_names(rows).select("folder", "ord", "target", "fresh")


@query("i21_export_plan", """with p as (select asset_id, abs_path, row_number() over (partition by asset_id order by id) as r from location where present), m as (select c.asset_id as id, c.position, a.kind, a.content_hash, p.abs_path from collection_asset c join asset a on a.id = c.asset_id left join p on p.asset_id = a.id and p.r = 1 where c.collection_id = 5)
    select id, position, case when kind = 'reference' then 'reference' when abs_path is null then 'missing' else 'copied' end as action, case when kind <> 'reference' then regexp_extract(abs_path, '[^/]*$') end as target from m""")  # fmt: skip
def _(t):
    return X.export_plan(t, 5, "kind").select("id", "position", "action", "target")


@query("s10_manifest", """with tg as (select asset_id, string_agg(distinct name, ',' order by name) as tags from named_tag group by 1), p as (select asset_id, abs_path, row_number() over (partition by asset_id order by id) as r from location where present)
    select a.id, a.kind, a.title, a.content_hash, coalesce(a.source_name, '') as source_name, coalesce(a.license, '') as license, tg.tags, regexp_extract(p.abs_path, '[^/]*$') as file from asset a left join tg on tg.asset_id = a.id left join p on p.asset_id = a.id and p.r = 1""")  # fmt: skip
def _(t):
    return X.manifest(t).select("id", "kind", "title", "content_hash", "source_name", "license", F.array_join("tags", ",").alias("tags"), "file")


@query("s11_credits", """with x as (select id as ord, title, coalesce(source_url, '') as url, kind, case when source_name in ('src1', 'src2') and coalesce(license, '') = '' then '' else coalesce(source_name, '') end as source, coalesce(license, '') as license from asset),
      e as (select *, case when source = '' and license = '' then 1 else 0 end as section from x where kind <> 'reference'), y as (select *, row_number() over (partition by section, source, license order by ord) as r, count(*) over (partition by section, source, license) as n from e)
    select section, case when section = 1 then 'No source or licence recorded' when source = '' then 'Unattributed' else source end as heading, license, case when section = 0 then coalesce(min_by(url, ord) filter (url <> ''), '') else '' end as url, max(n) as n,
      string_agg(title, chr(10) order by ord) filter (r <= 20) as titles, greatest(max(n) - 20, 0) as more, null::bigint as place from y group by section, source, license
    union all select 2, 'References', '', '', 1, title, 0, ord from x where kind = 'reference'""")  # fmt: skip
def _(t):
    blank = F.col("source_name").isin("src1", "src2") & (F.coalesce("license", F.lit("")) == "")
    return X.credits(t.asset.withColumns({"ord": F.col("id"), "source_name": F.when(blank, None).otherwise(F.col("source_name"))}))


@query("s7_html_head", "select page_id, trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)) as title from pages where html not like '%<title>%&%</title>%'")
def _(t):
    heads = L.html_head(t.pages.where("html not like '%<title>%&%</title>%'"), keep=("page_id", "url"))
    return heads.select("page_id", F.trim(F.try_element_at("head", F.lit("title"))).alias("title"))


@query("s8_page_record", f"select url, coalesce(nullif(substring(trim(regexp_replace(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), 1, 500), ''), {slug_sql('url')}) as title, '' as description, {host_sql('url')} as site_name, null::varchar as image_url from pages where html not like '%<title>%&%</title>%'")
def _(t):
    return L.page_record(L.html_head(t.pages.where("html not like '%<title>%&%</title>%'")))


@query("u1_add_tags", "with n as (select asset_id, tag_id, 'manual' as source from asset_tag where source = 'heuristic') select asset_id, tag_id, source from asset_tag union select * from n")
def _(t):
    new = t.asset_tag.where("source = 'heuristic'").select("asset_id", "tag_id", F.lit("manual").alias("source"), "confidence")
    return U.add_tags(t.asset_tag, new)[0].select("asset_id", "tag_id", "source")


@query("u2_remove_tags", "select asset_id, tag_id, source from asset_tag where not (source = 'manual' and asset_id % 2 = 0)")
def _(t):
    return U.remove_tags(t.asset_tag, t.asset_tag.where("asset_id % 2 = 0")).select("asset_id", "tag_id", "source")


@query("u3_bulk_tags", "with g as (select id from tag where name = 'good'), x as (select id from tag where name = 'toxic'), s as (select id from asset where kind = 'audio') select asset_id, tag_id, source from asset_tag where not (source = 'manual' and tag_id in (select id from x) and asset_id in (select id from s)) union select s.id, g.id, 'manual' from s, g")
def _(t):
    pick = lambda n: t.tag.where(F.col("name") == n).select(F.col("id").alias("tag_id"))
    return U.bulk_tags(t.asset_tag, t.asset.where("kind = 'audio'"), pick("good"), pick("toxic")).select("asset_id", "tag_id", "source")


@query("u4_edit_fields", "select id, title, case when managed then 'CC0' else license end as license, case when managed then timestamp '2030-01-01' else updated_at end as updated_at from asset")
def _(t):
    return U.edit_fields(t.asset, P.find(t, is_="managed"), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), license="CC0", title="not in bulk", nonsense="x").select("id", "title", "license", "updated_at")


@query("u5_add_to_set", """with n as (select 3::bigint as asset_id, 0 as a, 1::bigint as b union all select 1, 0, 2 union all select id, 1, row_number() over (order by id) from asset where kind = 'audio'), m as (select asset_id, min(a * 1000000000 + b) as ord from n group by 1), f as (select m.* from m where asset_id not in (select asset_id from collection_asset where collection_id = 2))
    select asset_id, position from collection_asset where collection_id = 2 union all select asset_id, (select max(position) from collection_asset where collection_id = 2) + row_number() over (order by ord, asset_id) from f""")  # fmt: skip
def _(t):
    from ..operators.search import ranked

    listed = t.spark.createDataFrame([(3, 1), (1, 2)], "id bigint, ord bigint")
    found = ranked(t.asset.where("kind = 'audio'").select("id", F.col("id").alias("score")))
    return U.add_to_set(t.collection_asset.where("collection_id = 2"), 2, listed, found).select("asset_id", "position")


@query("u6_create_set", "with n as (select distinct lower(n_name) as name from nation), c as (select id, name from collection where id <> 4) select id, case when id = 3 then 'renamed-set' else name end as name from c union all select (select max(id) from collection) + row_number() over (order by trim(regexp_replace(name, '[^a-z0-9]+', '-', 'g'), '-')), trim(regexp_replace(name, '[^a-z0-9]+', '-', 'g'), '-') from n")
def _(t):
    made = U.create_set(t.collection, t.nation.select(F.lower("n_name").alias("name"), F.lit("").alias("notes")).union(t.collection.select(F.upper("name"), F.lit("x"))).union(t.region.select(F.lit("  "), F.lit(""))))
    return U.delete_set(U.update_set(made, 3, name="Renamed Set"), t.collection_asset, 4)[0].select("id", "name")


_HERE = "exists (select 1 from location l where l.asset_id = a.id and l.present)"


@query("b1_pending_vectors", f"select id, kind from asset a where kind in ('image', 'model3d') and {_HERE} and not exists (select 1 from embedding e where e.asset_id = a.id and e.model = 'old') order by id limit 300")
def _(t):
    return B.pending_vectors(t, "old", 300)


@query("b2_pending_tiles", f"with s as (select asset_id, max(value_num) filter (key = 'width') as w, max(value_num) filter (key = 'height') as h from attribute where key in ('width', 'height') group by 1) select a.id, a.kind, a.content_hash from asset a left join s on s.asset_id = a.id where kind <> 'reference' and {_HERE} and content_hash not in (select content_hash from asset where id % 7 = 0) and not (kind = 'image' and s.w is not null and s.h is not null and greatest(s.w, s.h) <= 256)")
def _(t):
    return B.pending_tiles(t, t.asset.where("id % 7 = 0"))


@query("b3_pending_captions", f"select id, id % 100 as ord from asset a where kind in ('image', 'model3d') and coalesce(caption, '') = '' and {_HERE} and not exists (select 1 from named_tag n where n.asset_id = a.id and n.name = 'normal-map') order by id % 100, id limit 150")
def _(t):
    return B.pending_captions(t, t.asset.select("id", (F.col("id") % 100).alias("ord")), limit=150)


_LOG = "select user_id as key, ts, event_id as seq, case event_type when 'error' then 'failure' when 'purchase' then 'success' when 'signup' then 'requeue' else 'other' end as outcome from events"
FOLD = f"""log as ({_LOG}), marks as (select key, max(ts) as since from log where outcome = 'requeue' group by 1), rest as (select l.* from log l left join marks m on m.key = l.key where l.outcome in ('success', 'failure') and (m.since is null or l.ts > m.since)),
    last as (select key, count(*) filter (outcome = 'failure') as attempts, max_by(outcome, ts) as last from rest group by 1), folded as (select k.key, case when l.last = 'success' then 'done' when coalesce(l.attempts, 0) >= 3 then 'failed' else 'pending' end as state, coalesce(l.attempts, 0)::bigint as attempts from (select distinct key from log) k left join last l on l.key = k.key)"""


def attempts(t):
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "requeue").otherwise("other")
    return t.events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), outcome.alias("outcome"))


@query("b4_work_status", f"with {FOLD} select state, count(*) as n from folded group by 1")
def _(t):
    return B.work_status(B.fold_attempts(attempts(t)))


@query("b5_fold_attempts", f"with {FOLD} select key, state, attempts from folded")
def _(t):
    return B.fold_attempts(attempts(t))


__all__ = ["_RAW_SQL", "_U", "_raw", "address_lines"]
