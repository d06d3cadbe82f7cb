"""Queries of numeric detectors, streams and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import features as D
from ..operators import hooks as V
from ..operators import search as R
from ..sources import files as S
from ..sources.catalog import Catalog
from ..sources.inventory import inventory, watch
from ..sources.shared import shared_folder
from ..streaming import streams as X
from .changes import FOLD, attempts
from .registry import query

#: An 8 x 8 raster of each vector: red from the component, green from its left neighbour's, blue from both.
_PX = """px as (select vec_id as asset_id, y, x, floor((embedding[y * 8 + x + 1]::double + 1) * 127)::int as r, floor((embedding[y * 8 + (x + 1) % 8 + 1]::double + 1) * 127)::int as g, case when vec_id % 3 = 0 then 230 else floor((embedding[((y + 1) % 8) * 8 + x + 1]::double + 1) * 127)::int end as b,
    case when vec_id % 4 = 0 and (x in (3, 4) or y = 4) then 0 else 255 end as a from embeddings, range(0, 8) a(y), range(0, 8) b(x))"""


def pixels(t):
    level = lambda i: F.floor((F.get("embedding", i).cast("double") + 1) * 127).cast("int")
    cells = t.embeddings.select(F.col("vec_id").alias("asset_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).withColumns({"y": F.floor(F.col("k") / 8).cast("int"), "x": (F.col("k") % 8).cast("int")})
    blue = F.when(F.col("asset_id") % 3 == 0, 230).otherwise(level(((F.col("y") + 1) % 8) * 8 + F.col("x")))
    alpha = F.when((F.col("asset_id") % 4 == 0) & (F.col("x").isin(3, 4) | (F.col("y") == 4)), 0).otherwise(255)
    return cells.select("asset_id", "y", "x", level(F.col("y") * 8 + F.col("x")).alias("r"), level(F.col("y") * 8 + (F.col("x") + 1) % 8).alias("g"), blue.alias("b"), alpha.alias("a"))


@query("d1_raster_facts", f"with {_PX} select asset_id, (max(x) + 1)::bigint as width, (max(y) + 1)::bigint as height, 1.0::double as aspect, bool_or(a < 255) as has_alpha, least(count(distinct (r, g, b, a)), 4096) as color_count from px group by 1")
def _(t):
    return D.raster_facts(pixels(t))


_GRID = "grid as (select vec_id as asset_id, y, x, embedding[(y * 7 + x) % 64 + 1]::double as value from embeddings, range(0, 8) a(y), range(0, 9) b(x))"


@query("d2_dhash", f"with {_GRID} select a.asset_id, bit_or(case when b.value > a.value then 1::hugeint << (63 - (b.y * 8 + b.x - 1))::int else 0 end)::varchar as dhash from grid a join grid b on b.asset_id = a.asset_id and b.y = a.y and b.x = a.x + 1 group by 1")
def _(t):
    cells = t.embeddings.select(F.col("vec_id").alias("asset_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(71))).alias("k")).withColumns({"y": F.floor(F.col("k") / 9).cast("int"), "x": (F.col("k") % 9).cast("int")})
    grid = cells.select("asset_id", "y", "x", F.get("embedding", (F.col("y") * 7 + F.col("x")) % 64).cast("double").alias("value"))
    unsigned = F.when(F.col("dhash") < 0, F.col("dhash").cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.col("dhash").cast("decimal(20,0)"))
    return D.dhash(grid).select("asset_id", unsigned.cast("string").alias("dhash"))


_STEP = f"""{_PX}, st as (select *, (abs(r - lag(r) over v) + abs(g - lag(g) over v) + abs(b - lag(b) over v)) / 3.0::double as dy, (abs(r - lag(r) over h) + abs(g - lag(g) over h) + abs(b - lag(b) over h)) / 3.0::double as dx from px window v as (partition by asset_id, x order by y), h as (partition by asset_id, y order by x)),
    wr as (select f.asset_id, avg((abs(f.r - l.r) + abs(f.g - l.g) + abs(f.b - l.b)) / 3.0::double) as w from px f join px l on l.asset_id = f.asset_id and l.x = f.x where f.y = 0 and l.y = 7 group by 1),
    wc as (select f.asset_id, avg((abs(f.r - l.r) + abs(f.g - l.g) + abs(f.b - l.b)) / 3.0::double) as w from px f join px l on l.asset_id = f.asset_id and l.y = f.y where f.x = 0 and l.x = 7 group by 1),
    sm as (select s.asset_id, avg(dy) + avg(dx) as inside, avg((a >= 16)::int) as opaque, (avg(dx) filter (y = 0) + avg(dx) filter (y = 7) + avg(dy) filter (x = 0) + avg(dy) filter (x = 7)) / 4 as edge from st s group by 1),
    seam as (select sm.asset_id, (wr.w + wc.w) / sm.inside as seam_score, edge / (inside / 2) as border, opaque from sm join wr using (asset_id) join wc using (asset_id))"""


@query("d3_seams", f"with {_STEP} select asset_id, round(seam_score, 6) as seam_score, round(border, 6) as border, round(opaque, 6) as opaque from seam")
def _(t):
    return D.seams(pixels(t)).select("asset_id", *[F.round(c, 6).alias(c) for c in ("seam_score", "border", "opaque")])


@query("d3_tileable", f"with {_STEP} select asset_id, round(seam_score, 3) as seam_score, 'tileable' as name, 0.8::double as confidence from seam where opaque >= 0.95 and seam_score <= 1.5 and border >= 0.25")
def _(t):
    return D.tileable(pixels(t))


@query("d4_normal_map", f"with {_PX} select asset_id, 'normal-map' as name, 0.9::double as confidence from px group by 1 having avg(b) > 200 and avg(r) > 96 and avg(r) < 160 and avg(g) > 96 and avg(g) < 160 and avg((b >= r and b >= g)::int) >= 0.9")
def _(t):
    return D.normal_map(pixels(t))


_TONES = "tone as (select vec_id as asset_id, y, x, case when embedding[y * 8 + x + 1] > 0.15 then case when vec_id % 2 = 0 then 200 else 90 end when embedding[y * 8 + x + 1] > -0.02 then 40 else 10 end as r from embeddings, range(0, 8) a(y), range(0, 8) b(x))"


@query("d5_mask", f"with {_TONES}, c as (select asset_id, r, count(*) as n from tone group by all), k as (select *, row_number() over (partition by asset_id order by n desc, r) as k from c) select asset_id, 'mask' as name, 0.7::double as confidence from k group by 1 having sum(n) filter (k <= 2) / sum(n) >= 0.9")
def _(t):
    v = F.get("embedding", F.col("k"))
    cells = t.embeddings.select(F.col("vec_id").alias("asset_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    tone = F.when(v > F.lit(0.15).cast("float"), F.when(F.col("asset_id") % 2 == 0, 200).otherwise(90)).when(v > F.lit(-0.02).cast("float"), 40).otherwise(10)
    grey = cells.select("asset_id", F.floor(F.col("k") / 8).cast("int").alias("y"), (F.col("k") % 8).cast("int").alias("x"), tone.alias("r"))
    return D.mask(grey.withColumns({"g": F.col("r"), "b": F.col("r"), "a": F.lit(255)}))


#: 16 x 16 sheets: a gutter each 4 columns and 8 rows in even pictures, none in odd ones; some cells are empty.
_SHEET = "sheet as (select vec_id as asset_id, y, x, case when vec_id % 2 = 0 and (x % 4 = 3 or y % 8 = 7) then 0 when vec_id % 2 = 0 and embedding[(y // 8) * 4 + x // 4 + 1] < -0.05 then 0 else 255 end as a from embeddings, range(0, 16) a(y), range(0, 16) b(x))"


@query("d6_sprite_grid", f"""with {_SHEET}, axis as (select asset_id, 'x' as axis, x as p, bool_or(a >= 16) as used from sheet group by all union all select asset_id, 'y', y, bool_or(a >= 16) from sheet group by all),
    tries as (select n, s from (values (2), (4)) v(n), (values (0), (-1)) w(s)), free as (select asset_id, axis, n, s from axis, tries where p in (select k * (16 // n) + s from range(1, 16) r(k) where k < n) group by all having not bool_or(used)),
    cells as (select i.asset_id, i.axis, coalesce(max(f.n), 1) as n from (select distinct asset_id, axis from axis) i left join free f on f.asset_id = i.asset_id and f.axis = i.axis group by all),
    g as (select c.asset_id, c.n as cols, r.n as rows from cells c join cells r on r.asset_id = c.asset_id and r.axis = 'y' where c.axis = 'x' and c.n * r.n >= 2),
    f as (select g.asset_id, cols, rows, count(distinct (x // (16 // cols), y // (16 // rows))) as frames from g join sheet s on s.asset_id = g.asset_id where s.a >= 16 group by all)
    select asset_id, cols::bigint as cols, rows::bigint as rows, frames, 'spritesheet' as name, case when frames >= 4 then 0.8 else 0.6 end::double as confidence from f where frames >= greatest(2, (cols * rows + 1) // 2)""")  # fmt: skip
def _(t):
    cells = t.embeddings.select(F.col("vec_id").alias("asset_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("k")).withColumns({"y": F.floor(F.col("k") / 16).cast("int"), "x": (F.col("k") % 16).cast("int")})
    even = F.col("asset_id") % 2 == 0
    cell = (F.floor(F.col("y") / 8) * 4 + F.floor(F.col("x") / 4)).cast("int")
    alpha = F.when(even & ((F.col("x") % 4 == 3) | (F.col("y") % 8 == 7)), 0).when(even & (F.get("embedding", cell).cast("double") < -0.05), 0).otherwise(255)
    return D.sprite_grid(cells.select("asset_id", "y", "x", alpha.alias("a")))


_HOURS = "ser as (select event_type as series_id, row_number() over (partition by event_type order by h) - 1 as i, n as value from (select event_type, date_trunc('hour', ts) as h, count(*) as n from events group by all))"
_SHARP = f"""{_HOURS}, cen as (select series_id, i, value - avg(value) over (partition by series_id) as c from ser), var as (select series_id, avg(c * c) as v from cen group by 1),
    cor as (select a.series_id, k.k, avg(a.c * b.c) / max(v.v) as r from cen a join range(1, 34) k(k) on true join cen b on b.series_id = a.series_id and b.i = a.i + k.k join var v on v.series_id = a.series_id group by all),
    sharp as (select b.series_id, b.k as lag, b.r - (a.r + c.r) / 2 as sharp from cor b join cor a on a.series_id = b.series_id and a.k = b.k - 1 join cor c on c.series_id = b.series_id and c.k = b.k + 1)"""


def hours(t):
    from pyspark.sql import Window

    rows = t.events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("value"))
    return rows.select("series_id", (F.row_number().over(Window.partitionBy("series_id").orderBy("h")) - 1).cast("bigint").alias("i"), "value")


@query("d7_sharpness", f"with {_SHARP} select series_id, lag::int as lag, round(sharp, 6) as sharp from sharp")
def _(t):
    return D.sharpness(hours(t)).withColumn("sharp", F.round("sharp", 6))


@query("d7_period", f"with {_SHARP}, top as (select series_id, max(sharp) as top from sharp group by 1) select t.series_id, min(lag) filter (sharp >= 0.9 * top and top >= 0.2)::bigint as period from top t join sharp s on s.series_id = t.series_id group by 1")
def _(t):
    return D.period(hours(t))


#: 32 x 32 pictures in blocks of 4; every third one has noise within its blocks.
_BLOCK = "art as (select vec_id as asset_id, y, x, floor((embedding[((y // 4) * 8 + x // 4) % 64 + 1]::double + 1) * 100)::int + case when vec_id % 3 = 0 then (x * 7 + y * 13) % 40 else 0 end as v from embeddings, range(0, 32) a(y), range(0, 32) b(x))"


def _art(t):
    cells = t.embeddings.select(F.col("vec_id").alias("asset_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(1023))).alias("k")).withColumns({"y": F.floor(F.col("k") / 32).cast("int"), "x": (F.col("k") % 32).cast("int")})
    noise = F.when(F.col("asset_id") % 3 == 0, (F.col("x") * 7 + F.col("y") * 13) % 40).otherwise(0)
    v = F.floor((F.get("embedding", (F.floor(F.col("y") / 4) * 8 + F.floor(F.col("x") / 4)).cast("int")).cast("double") + 1) * 100).cast("int") + noise
    return cells.select("asset_id", "y", "x", v.alias("r"), v.alias("g"), v.alias("b"), F.lit(255).alias("a"))


@query("d8_upscale", f"with {_BLOCK}, s as (select asset_id, y // 4 as by, x // 4 as bx, max(v) - min(v) as spread from art group by all) select asset_id, 4::bigint as block_size, 'pixel-art' as name, 0.9::double as confidence from s group by 1 having avg(spread) <= 8")
def _(t):
    return D.upscale(_art(t), t.embeddings.select(F.col("vec_id").alias("asset_id"), F.lit(4).alias("period")))


@query("d9_native_pixel_art", "with f as (select p_partkey as asset_id, p_size * 5 as w, 16 + p_partkey % 200 as h, p_partkey % 128 as c from part) select asset_id, 1::bigint as block_size, 'pixel-art' as name, 0.6::double as confidence from f where greatest(w, h) <= 128 and c <= 64")
def _(t):
    return D.native_pixel_art(t.part.select(F.col("p_partkey").alias("asset_id"), (F.col("p_size") * 5).alias("width"), (16 + F.col("p_partkey") % 200).alias("height"), (F.col("p_partkey") % 128).alias("color_count")))


def _stream(t, *columns):
    """The events table as a stream; its files are those that Spark lists for the table."""
    rows = t.events
    return t.spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)


_SNAPSHOT = "select event_type, concat('/lib/', user_id % 500, '/', event_type) as path, count(*) as size, max(ts) as mtime, min(user_id % 5) as root_id from events where {} group by all"


@query("x1_ingest", f"""with one as ({_SNAPSHOT.format('event_id % 3 <> 0')}), two as ({_SNAPSHOT.format('event_id % 2 = 0')}),
    a as (select path, event_type, substring(sha256(path[-3:] || size), 1, 32) as h, size, mtime from one), b as (select path, event_type, substring(sha256(path[-3:] || size), 1, 32) as h, size, mtime from two),
    items as (select h, min(path) as title from a group by 1), later as (select h, min(path) as title from b where h not in (select h from items) and path not in (select a.path from a join b on a.path = b.path and a.size = b.size and a.mtime = b.mtime) group by 1)
    select coalesce(b.path, a.path) as abs_path, case when b.path is null or (a.size = b.size and a.mtime = b.mtime) then a.h else b.h end as content_hash, b.path is not null as present from a full join b on a.path = b.path""")
def _(t):
    """Two full listings of the roots, one after the other: new, changed, kept, moved and missing files."""
    catalog = _ingested(t)
    place, asset = catalog.read("location"), catalog.read("asset").select(F.col("id").alias("asset_id"), "content_hash")
    return place.join(asset, "asset_id").select("abs_path", "content_hash", "present")


def _ingested(t):
    folder = shared_folder(t.spark)
    catalog = Catalog(t.spark, f"{folder}/catalog")
    path = F.concat(F.lit("/lib/"), (F.col("user_id") % 500).cast("string"), F.lit("/"), "event_type").alias("path")
    for k, keep in enumerate((F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0)):
        rows = t.events.where(keep).groupBy("event_type", path).agg(F.count("*").alias("size"), F.max("ts").alias("mtime"), F.min(F.col("user_id") % 5).alias("root_id"))
        digest = F.substring(F.sha2(F.concat(F.substring("path", -3, 3), F.col("size").cast("string")).cast("binary"), 256), 1, 32)
        rows = rows.select("path", digest.alias("content_hash"), F.lit("image").alias("kind"), F.col("path").alias("title"), F.lit("indexed").alias("mode"), "root_id", "size", F.col("mtime").cast("timestamp_ntz").alias("mtime"))
        rows.write.parquet(f"{folder}/listing/{k}")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/listing/{k}")
        X.start_ingest(stream, catalog, f"{folder}/checkpoint/{k}", t.spark.range(5)).awaitTermination()
    return catalog


@query("x1_search", f"""with one as ({_SNAPSHOT.format('event_id % 3 <> 0')}), two as ({_SNAPSHOT.format('event_id % 2 = 0')}),
    a as (select path, event_type, substring(sha256(path[-3:] || size), 1, 32) as h, size, mtime from one), b as (select path, event_type, substring(sha256(path[-3:] || size), 1, 32) as h, size, mtime from two),
    known as (select a.path from a join b on a.path = b.path and a.size = b.size and a.mtime = b.mtime),
    items as (select h, min(path) as title from a group by 1), later as (select h, min(path) as title from b where h not in (select h from items) and path not in (from known) group by 1), every as (select * from items union all select * from later),
    place as (select coalesce(b.path, a.path) as path, case when b.path is null or b.path in (from known) then a.h else b.h end as h from a full join b on a.path = b.path),
    names as (select h, count(distinct regexp_extract(path, '[^/]*$')) as n from place group by 1)
    select e.h as content_hash, 3 + coalesce(n.n, 0) as words, e.title from every e left join names n on n.h = e.h where e.title like '/lib/%/p%'""")
def _(t):
    """What the text index that ingest keeps holds of the items whose title names a purchase or the like: how many words, and where they first stood."""
    catalog = _ingested(t)
    index, asset = R.Segments(catalog.snapshot()), catalog.read("asset").select("id", "content_hash", "title")
    first = index.posting.where("field = 'title' and pos = 2 and token like 'p%'").select("id")
    return asset.join(first, "id").join(index.docs.select("id", F.col("length").cast("bigint").alias("words")), "id").select("content_hash", "words", "title")


@query("x2_dedupe", "select distinct user_id, event_type from events")
def _(t):
    rows = X.dedupe_stream(_stream(t, "ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "60 days")
    return X.drain(rows, t.spark).select("user_id", "event_type")


@query("x3_fold_attempts", f"with {FOLD} select key, state, attempts from folded")
def _(t):
    class Stream:
        events = _stream(t, "ts", "user_id", "event_id", "event_type")

    out = X.drain(X.fold_attempts_stream(attempts(Stream)), t.spark, "update")
    return out.groupBy("key").agg(F.max_by(F.struct("state", "attempts"), "seen").alias("x")).select("key", "x.*")


@query("x4_absent", "with l as (select user_id as key, max(ts) as last_seen from events group by 1) select key, last_seen from l where last_seen + interval 6 hours < (select max(ts) from events) - interval 1 hour")
def _(t):
    rows = _stream(t, F.col("user_id").alias("key"), "ts")
    return X.drain(X.absent_stream(rows, "6 hours", "1 hour"), t.spark).select("key", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


def _encoder():
    return lambda texts: [None if len(x) % 7 == 0 else [float(len(x)), float(x.count("e"))] for x in texts]


@query("v2_embed", "with x as (select doc_id as asset_id, length(text)::double as a, (length(text) - length(replace(text, 'e', '')))::double as b from documents) select asset_id, 'stub' as model, case when a % 7 <> 0 then round(a / sqrt(a * a + b * b), 4) end as first, case when a % 7 = 0 then 'no result' end as error from x")
def _(t):
    out = V.embed(t.documents.select(F.col("doc_id").alias("asset_id"), F.col("text").alias("input")), _encoder, "stub")
    return out.select("asset_id", "model", F.round(F.col("vector")[0].cast("double"), 4).alias("first"), "error")


def _measure(frame):
    if (frame["asset_id"] % 50 == 7).any():
        raise ValueError("unreadable")
    return frame.assign(size=frame["notes"].str.len(), lines=frame["notes"].str.count("\n") + 1)


@query("v3_probe", "select id as asset_id, case when id % 50 <> 7 then length(notes) end as size, case when id % 50 <> 7 then length(notes) - length(replace(notes, chr(10), '')) + 1 end as lines, case when id % 50 = 7 then 'ValueError: unreadable' end as error from asset where kind in ('image', 'audio')")
def _(t):
    items = t.asset.select(F.col("id").alias("asset_id"), "kind", "notes")
    return V.probe(items, {"image": _measure, "audio": _measure}, "size long, lines long")


def _files(t) -> str:
    """Text files made of the customers: one for each nation in a folder of its own, and those of no nation's folder beside them."""
    root = f"{shared_folder(t.spark)}/files"
    rows = t.customer.select(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name").alias("value"), F.col("c_nationkey").alias("n"))
    rows.repartition("n").write.partitionBy("n").text(f"{root}/deep")
    rows.where("n % 2 = 0").drop("n").write.mode("append").text(root)
    return root


@query("s1_list_files", "select c_nationkey as folder, sum(octet_length(encode(c_custkey || '|' || c_name)) + 1)::bigint as size, true as dated from customer group by 1")
def _(t):
    found = S.list_files(t.spark, f"{_files(t)}/deep")
    return found.groupBy(F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("bigint").alias("folder")).agg(F.sum("size").alias("size"), F.bool_and(F.col("mtime").isNotNull()).alias("dated"))


@query("s1_inventory", "select c_nationkey as folder, read, sum(octet_length(encode(c_custkey || '|' || c_name)) + 1)::bigint as size from customer, (values ('batch'), ('stream')) v(read) group by 1, 2")
def _(t):
    """The same files by the inventory source, read at once and followed as a stream."""
    root = f"{_files(t)}/deep"
    found = inventory(t.spark, root).withColumn("read", F.lit("batch")).unionByName(X.drain(watch(t.spark, root, settle=0), t.spark).withColumn("read", F.lit("stream")))
    named = found.where("path like '%/part-%'")  # not the marks that Spark leaves beside them
    return named.groupBy(F.regexp_extract("path", "/n=([0-9]+)/", 1).cast("bigint").alias("folder"), "read").agg(F.sum("size").alias("size"))


@query("s4_not_recursive", "select sum(octet_length(encode(c_custkey || '|' || c_name)) + 1)::bigint as size from customer where c_nationkey % 2 = 0")
def _(t):
    """The files of a folder itself, not of those below it."""
    return S.list_files(t.spark, _files(t), recursive=False).agg(F.sum("size").alias("size"))


@query("s12_rasters", """with p as (select label, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, greatest(0, least(255, floor(128 + 100 * max(x))))::int as v from p where i < 64 group by all)
    select label::bigint as asset_id, (i // 8)::int as y, (i % 8)::int as x, v as r, v as g, 255 - v as b, 255 as a from m""")
def _(t):
    """Pictures of 8 x 8 pixels, one a label, written as bitmap files and read back."""
    from ..operators.features import pixels_of

    folder = f"{shared_folder(t.spark)}/rasters"
    level = lambda i: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 100 * F.max(F.col("embedding")[i].cast("double"))))).cast("int")
    wide = t.embeddings.groupBy("label").agg(*[level(i).alias(f"v{i}") for i in range(64)])
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    rows = [F.concat(two(255 - F.col(f"v{i}")), two(F.col(f"v{i}")), two(F.col(f"v{i}"))) for y in range(7, -1, -1) for i in range(8 * y, 8 * y + 8)]  # bottom row first, blue first
    head = "424d" + "f6000000" + "00000000" + "36000000" + "28000000" + "08000000" * 2 + "0100" + "1800" + "00000000" + "c0000000" + "00000000" * 4
    wide.select(F.unhex(F.concat(F.lit(head), *rows)).cast("string").alias("value"), "label").write.partitionBy("label").text(folder)
    found = S.read_rasters(t.spark, f"{folder}/label=*").withColumn("asset_id", F.regexp_extract("path", "label=([0-9]+)/", 1).cast("bigint"))
    return pixels_of(found).select("asset_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("int").alias(c) for c in "rgba"])


@query("f25_stamp", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as stamp from events")
def _(t):
    return t.events.select("event_id", N.write_stamp(F.col("ts").cast("timestamp_ntz")).alias("stamp"))


@query("s13_catalog_round_trip", "select asset_id, key, value_num from attribute where key = 'width' and value_num >= 500")
def _(t):
    catalog = Catalog(t.spark, shared_folder(t.spark))
    return catalog.write("attribute", t.attribute).where("key = 'width' and value_num >= 500").select("asset_id", "key", "value_num")


@query("s13_one_commit", """with o as (select l_suppkey as id, l_partkey as part from lineitem group by 1, 2), c as (select 'old' as version, id, count(*) as n from o where id % 2 = 0 group by 2 union all select 'new', id, count(*) from o where id % 3 <> 0 group by 2)
    select version, c.id, 'set-' || c.id as name, n from c""")
def _(t):
    """Sets and their members written in one commit, twice: a reader of the first version goes on to see both of its tables."""
    catalog = Catalog(t.spark, shared_folder(t.spark))
    pairs = t.lineitem.select(F.col("l_suppkey").alias("collection_id"), F.col("l_partkey").alias("asset_id")).distinct()
    seen = []
    for keep in ("collection_id % 2 = 0", "collection_id % 3 <> 0"):
        change = catalog.begin()
        change.write("collection", pairs.where(keep).select(F.col("collection_id").alias("id"), F.concat(F.lit("set-"), F.col("collection_id").cast("string")).alias("name")).distinct())
        change.write("collection_asset", pairs.where(keep))
        change.commit()
        seen.append(catalog.snapshot(1 + len(seen)))
    out = [x.collection.join(x.collection_asset.groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("n")), "id").select(F.lit(v).alias("version"), "id", "name", "n") for v, x in zip(("old", "new"), seen, strict=True)]
    return out[0].union(out[1])


@query("s13_put_and_remove", "select s_suppkey as id, case when s_suppkey % 2 = 0 then 'second' else s_name end as name from supplier where s_suppkey % 5 <> 0")
def _(t):
    """Rows put by key and keys taken away, read over the whole table they change."""
    catalog, named = Catalog(t.spark, shared_folder(t.spark)), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    change = catalog.begin()
    change.write("collection", named)
    change.put("collection", named.where("id % 2 = 0").select("id", F.lit("second").alias("name")))
    change.remove("collection", named.where("id % 5 = 0"))
    return change.commit().collection.select("id", "name")
