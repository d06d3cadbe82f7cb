"""Queries of full-text, hybrid and tag operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import links as L
from ..operators import ranking as W
from ..operators import search as R
from ..operators import tags as G
from ..operators.textindex import reindex
from ..sources.catalog import Catalog
from ..sources.shared import shared_folder
from .browse import _library, _queries, cells, hashes
from .browse import _HASH, _QV
from .registry import query

_MARK = f"translate(lower({{}}), '{R.MARKED}', '{R.PLAIN}')"
_TOK = rf"regexp_extract_all({_MARK}, '[\p{{{{L}}}}\p{{{{N}}}}]+')"
#: Postings of all five fields; documents with their lengths; the totals.
_POST = f"""names as (select asset_id, string_agg(file, ' ' order by id) as filename from (select asset_id, regexp_extract(abs_path, '[^/]*$') as file, min(id) as id from location group by 1, 2) group by 1),
    labels_of as (select asset_id, string_agg(name, ' ' order by name) as tags from (select distinct asset_id, name from named_tag) group by 1),
    docs as (select a.id, a.title, a.notes, n.filename, a.caption, l.tags from asset a left join names n on n.asset_id = a.id left join labels_of l on l.asset_id = a.id),
    words as ({" union all ".join(f"select id, '{f}' as field, coalesce({_TOK.format(f)}, []) as w from docs" for f in R.FIELDS)}),
    post as (select id, field, unnest(range(0, len(w))) as pos, unnest(w) as token from words), lens as (select id, sum(len(w))::double as length from words group by 1), tot as (select count(*)::double as n, avg(length) as mean from lens)"""


def _bm25(*phrases: list[str]) -> str:
    """CTEs that end in ``scores (id, score)`` for words or phrases."""
    hits = []
    for i, p in enumerate(phrases):
        joins = " ".join(f"join post p{k} on p{k}.id = p0.id and p{k}.field = p0.field and p{k}.pos = p0.pos + {k} and p{k}.token = '{x}'" for k, x in enumerate(p) if k)
        hits.append(f"select p0.id, {i} as i, count(*) as n from post p0 {joins} where p0.token = '{p[0]}' group by 1")
    return f"""{_POST}, hits as ({" union all ".join(hits)}), idf as (select i, greatest(ln(((select n from tot) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf from hits group by 1),
    scores as (select h.id, -sum(idf.idf * h.n * 2.2 / (h.n + 1.2 * (0.25 + 0.75 * l.length / (select mean from tot)))) as score from hits h join idf on idf.i = h.i join lens l on l.id = h.id group by 1 having count(*) = {len(phrases)})"""


@query("r1_postings", f"with {_POST} select id, field, pos::int as pos, token from post")
def _(t):
    return R.postings(A.text_docs(t))


@query("r2_match_all", f"with {_POST} select id from post where token in ('the', 'onon') group by 1 having count(distinct token) = 2")
def _(t):
    return R.match_all(t.index, ["The", "*", "onon"])


@query("r3_phrase", f"with {_POST} select distinct a.id from post a join post b on b.id = a.id and b.field = a.field and b.pos = a.pos + 1 and b.token = 'the' where a.token = 'of'")
def _(t):
    return R.match_all(t.index, ["of the"])


@query("r4_bm25", f"with {_bm25(['the'], ['of', 'the'])} select id, round(score, 6) as score from scores")
def _(t):
    return R.bm25(t.index, ["the", "of-the"]).withColumn("score", F.round("score", 6))


@query("r4_best_matches", f"with {_bm25(['the'], ['of'])} select id, round(score, 6) as score, row_number() over (order by round(score, 9), id) as rank from scores qualify rank <= 40")
def _(t):
    """The first 40, from the blocks of the stored index that can hold them."""
    return R.best_matches(t.index, ["the", "of"], 40).withColumn("score", F.round("score", 6))


_EDITED = """edited as (select doc_id as id, case when doc_id % 5 = 0 then concat(source, ' changed ', lang) else text end as notes from documents where doc_id % 7 <> 3),
    words as (select id, 'notes' as field, {} as w from edited), post as (select id, field, unnest(range(0, len(w))) as pos, unnest(w) as token from words), lens as (select id, sum(len(w))::double as length from words group by 1), tot as (select count(*)::double as n, avg(length) as mean from lens)""".format(f"coalesce({_TOK.format('notes')}, [])")


def _edited(t):
    """An index of two thirds of the documents; the others are added in a second commit, and in a third a fifth is changed and a seventh taken away."""
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("notes"))
    catalog = Catalog(t.spark, shared_folder(t.spark))
    R.TextIndex(docs.where("id % 3 <> 0")).store(catalog)
    late = docs.where("id % 3 = 0")
    changed = t.documents.where("doc_id % 5 = 0 and doc_id % 7 <> 3").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" changed "), "lang").alias("notes"))
    for new, ids in ((late, late), (changed, docs.where("id % 5 = 0 or id % 7 = 3"))):
        change = catalog.begin()
        reindex(change, new, ids.select("id"))
        change.commit()
    return R.Segments(catalog.snapshot())


@query("r1_segments", f"with {_EDITED} select id, field, pos::int as pos, token from post")
def _(t):
    """All words of an index after additions, changes and deletions."""
    return _edited(t).posting.select("id", "field", "pos", "token")


@query("r4_after_changes", f"with {_bm25(['of', 'the'], ['and']).replace(_POST, _EDITED)} select id, round(score, 6) as score from scores")
def _(t):
    """Scores of that index: numbers of documents and mean length are those of what is there."""
    return R.bm25(_edited(t), ["of the", "and"]).withColumn("score", F.round("score", 6))


@query("r4_best_after_changes", f"with {_bm25(['changed']).replace(_POST, _EDITED)} select id, round(score, 6) as score, row_number() over (order by round(score, 9), id) as rank from scores qualify rank <= 25")
def _(t):
    return R.best_matches(_edited(t), ["changed"], 25).withColumn("score", F.round("score", 6))


@query("j6_text_scored", f"with {_bm25(['and'])} select a.id, a.kind, round(s.score, 6) as score from asset a join scores s on s.id = a.id where a.managed")
def _(t):
    from ..operators.joins import text_scored

    return text_scored(P.find(t, is_="managed"), R.bm25(t.index, ["and"])).select("id", "kind", F.round("score", 6).alias("score"))


_RANKS = "x as (select id, row_number() over (order by size desc, id) as rank from (select asset_id as id, max(size) as size from location group by 1)), y as (select id, row_number() over (order by added_at, id) as rank from asset where kind = 'image')"


def _two(t):
    x = t.location.groupBy(F.col("asset_id").alias("id")).agg(F.max("size").alias("score"))
    y = P.find(t, kind="image").select("id", F.unix_micros(F.col("added_at").cast("timestamp")).alias("score"))
    return R.ranked(x, ascending=False), R.ranked(y)


@query("r5_fuse", f"with {_RANKS}, f as (select id, sum(1.0::double / (60 + rank)) as s from (select * from x union all select * from y) group by 1) select id, round(s, 6) as score from f")
def _(t):
    return R.fuse(*_two(t)).select("id", F.round("score", 6).alias("score"))


_ONE = "select vec_id as query_id, embedding as q from embeddings where vec_id = 0"
_SEM = f"with s as (select vec_id as id, list_cosine_similarity(q::double[], embedding::double[]) as score from ({_ONE}), embeddings), r as (select *, row_number() over (order by score desc, id) as rank from s), sem as (select id, score, rank from r where rank <= 120 and score >= 0.24)"


@query("r6_semantic", f"{_SEM} select id, round(score, 6) as score, rank from sem")
def _(t):
    return R.semantic(_queries(t).where("query_id = 0"), _library(t)).select("id", F.round("score", 6).alias("score"), "rank")


@query("r6_cells", f"{_SEM} select id, round(score, 6) as score, rank from sem")
def _(t):
    """The same from stored cells of vectors."""
    return R.semantic(_queries(t).where("query_id = 0"), cells(t)).select("id", F.round("score", 6).alias("score"), "rank")


_FUSED = "lit as (select id, row_number() over (order by score, id) as rank from scores), sides as (select id, sum(1.0::double / (60 + rank)) as s from (select id, rank from lit union all select id, row_number() over (order by score desc, id) from sem) group by 1), fused as (select id, row_number() over (order by s desc, id) as rank from sides)"


def _hybrid(t, words, **kw):
    ranking = R.semantic(_queries(t).where("query_id = 0"), _library(t))
    return R.search(t, t.index, words, ranking, **kw)


@query("r7_hybrid", f"{_SEM}, {_bm25(['the'], ['onon'])}, {_FUSED} select a.id, row_number() over (order by f.rank) as rank from asset a join fused f on f.id = a.id where a.kind = 'image'")
def _(t):
    return _hybrid(t, ["the", "onon"], kind="image").select("id", "rank")


@query("v1_ranking", f"{_SEM} select a.id, row_number() over (order by s.score desc, a.id) as rank from asset a join sem s on s.id = a.id")
def _(t):
    return _hybrid(t, []).select("id", "rank")


@query("r8_text_order", f"with {_bm25(['the'])} select a.id, row_number() over (order by a.added_at desc, a.id) as rank from asset a join scores s on s.id = a.id")
def _(t):
    return R.search(t, t.index, ["the"]).select("id", "rank")


@query("r8_relevance", f"with {_bm25(['the'])} select a.id, row_number() over (order by round(s.score, 9), a.id) as rank from asset a join scores s on s.id = a.id")
def _(t):
    found = R.bm25(t.index, ["the"]).withColumn("score", F.round("score", 9))
    return t.asset.select("id").join(R.ranked(found), "id").select("id", "rank")


@query("w1_search_by_size", f"with {_bm25(['the'])}, s as (select asset_id, max(size) as m from location group by 1) select a.id, row_number() over (order by s.m desc nulls last, a.id) as rank from asset a join scores x on x.id = a.id left join s on s.asset_id = a.id")
def _(t):
    return R.search(t, t.index, ["the"], order_by="size").select("id", "rank")


@query("w3_search_page", f"with {_bm25(['the'])}, r as (select a.id, row_number() over (order by lower(a.title), a.id) as rank from asset a join scores x on x.id = a.id) select id, rank from r where rank between 26 and 50")
def _(t):
    return R.search(t, t.index, ["the"], order_by="name", limit=25, offset=25).select("id", "rank")


@query("r2_match_fields", f"with {_POST} select id from post where token in ('ferry', 'bell') or (token = 'ferrybell' and field = 'filename') group by 1 having count(distinct token) = 1 and max(token) = 'ferrybell'")
def _(t):
    """Only file names hold the word."""
    return R.match_all(t.index, ["ferryBell"])


@query("r9_similar", f"""with v as (select query_id, vec_id as id, list_cosine_similarity(q::double[], embedding::double[]) as c from ({_QV}), embeddings where query_id <> vec_id), r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from v), near as (select query_id, id, rank from r where rank <= 60 and c >= 0.8),
    h as ({_HASH}), d as (select q.id as query_id, h.id, bit_count(xor(q.v, h.v)) as distance from h q, h where q.id % 100 = 0 and q.id <> h.id and q.id not in (select query_id from near)), k as (select *, row_number() over (partition by query_id order by distance, id) as rank from d)
    select * from near union all select query_id, id, rank from k where rank <= 60 and distance <= 32""")  # fmt: skip
def _(t):
    h = hashes(t)
    return R.similar(_queries(t), _library(t), h.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), h)


_PAL = "list_transform([1, 4, 7, 10, 13, 16, 19, 22], lambda i: [floor((embedding[{}i]::double + 1) * 127), floor((embedding[{}i + 1]::double + 1) * 127), floor((embedding[{}i + 2]::double + 1) * 127)])"
_GAP = "sqrt(pow(x[1] - y[1], 2) + pow(x[2] - y[2], 2) + pow(x[3] - y[3], 2))"


@query("r10_palette_distance", f"""with p as (select vec_id, {_PAL.format('', '', '')} as a, {_PAL.format('30 + ', '30 + ', '30 + ')} as b from embeddings)
    select vec_id, round((list_avg(list_transform(a, lambda x: list_min(list_transform(b, lambda y: {_GAP})))) + list_avg(list_transform(b, lambda x: list_min(list_transform(a, lambda y: {_GAP}))))) / 2 / sqrt(3 * 65025.0), 6) as distance from p""")  # fmt: skip
def _(t):
    level = lambda i: F.floor((F.col("embedding")[i].cast("double") + 1) * 127).cast("int")
    pal = lambda off: F.array(*[F.struct(level(off + 3 * k).alias("r"), level(off + 3 * k + 1).alias("g"), level(off + 3 * k + 2).alias("b")) for k in range(8)])
    return t.embeddings.select("vec_id", F.round(R.palette_distance(pal(0), pal(30)), 6).alias("distance"))


@query("r10_palette_neighbours", f"""with p as (select vec_id, {_PAL.format('', '', '')} as a from embeddings), d as (select q.vec_id as query_id, p.vec_id as id, round((list_avg(list_transform(q.a, lambda x: list_min(list_transform(p.a, lambda y: {_GAP})))) + list_avg(list_transform(p.a, lambda x: list_min(list_transform(q.a, lambda y: {_GAP}))))) / 2 / sqrt(3 * 65025.0), 9) as distance from p q, p where q.vec_id % 100 = 0 and q.vec_id <> p.vec_id)
    select query_id, id, distance, row_number() over (partition by query_id order by distance, id) as rank from d qualify rank <= 60""")  # fmt: skip
def _(t):
    level = lambda i: F.floor((F.col("embedding")[i].cast("double") + 1) * 127).cast("int")
    palettes = t.embeddings.select(F.col("vec_id").alias("id"), F.array(*[F.struct(level(3 * k).alias("r"), level(3 * k + 1).alias("g"), level(3 * k + 2).alias("b")) for k in range(8)]).alias("p"))
    return R.palette_neighbours(palettes.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("p").alias("q")), palettes, 60)


@query("r11_facets_of_search", f"{_SEM}, {_bm25(['the'], ['onon'])}, {_FUSED} select g.name, g.namespace, count(distinct t.asset_id) as n from asset_tag t join tag g on g.id = t.tag_id where t.asset_id in (select id from fused) and t.asset_id in (select id from asset) group by all")
def _(t):
    return A.facets(_hybrid(t, ["the", "onon"]), t)


_TRUTH = "truth as (select q.vec_id as query_id, e.vec_id as id from embeddings q join embeddings e on e.label = q.label where q.vec_id % 100 = 0 and e.vec_id <> q.vec_id)"


@query("r12_evaluate", f"""with s as (select query_id, vec_id as id, list_cosine_similarity(q::double[], embedding::double[]) as c from ({_QV}), embeddings where query_id <> vec_id), r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from s), {_TRUTH},
    h as (select r.query_id, r.rank, t.id is not null as hit from r left join truth t on t.query_id = r.query_id and t.id = r.id where r.rank <= 60), e as (select query_id, count(*) filter (hit and rank <= 10) / 10.0 as p, coalesce(1.0 / min(rank) filter (hit), 0) as m from h group by 1)
    select round(avg(p), 6) as precision, round(avg(m), 6) as mrr from e""")  # fmt: skip
def _(t):
    ranking = W.top_k(_queries(t), _library(t), 60, -1.0)
    a = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    truth = a.join(t.embeddings.select(F.col("vec_id").alias("id"), "label"), "label").where("query_id <> id").select("query_id", "id")
    return R.evaluate(ranking, truth).select(*[F.round(c, 6).alias(c) for c in ("precision", "mrr")])


@query("r13_pair_percentiles", """with c as (select round((list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 0.001)::int as bin from embeddings a join embeddings b on a.vec_id < b.vec_id), h as (select bin, count(*) as n from c group by 1), s as (select bin, sum(n) over (order by bin) as c, sum(n) over () as t from h)
    select p as percent, min(bin) * 0.001::double - 1 as cosine from s, (values (0.01::double), (0.5::double), (0.99::double)) v(p) where c >= p * t group by 1""")  # fmt: skip
def _(t):
    return R.pair_percentiles(_library(t).select("id", F.col("v")))


@query("hybrid_find", f"with {_bm25(['the'])}, hit as (select s.id, s.score from scores s join asset a on a.id = s.id where exists (select 1 from asset_tag t join tag g on g.id = t.tag_id where t.asset_id = a.id and g.name = 'lang-en') and exists (select 1 from attribute x where x.asset_id = a.id and x.key = 'bytes' and x.value_num > 512)) select g.name, g.namespace, count(distinct t.asset_id) as n, (select count(*) from hit) as found from asset_tag t join tag g on g.id = t.tag_id where t.asset_id in (select id from hit) group by 1, 2 order by n desc, g.name limit 20")
def _(t):
    hits = R.search(t, t.index, ["the"], order_by="relevance", tags=["lang-en"], num=[("size", ">", 512)])
    found = hits.agg(F.count("*").alias("found"))
    return A.facets(hits, t, 20).join(F.broadcast(found))


_FILES = "select l.asset_id, l.abs_path as path, r.path as root_path, r.name as root_name, r.vendor from location l join root r on r.id = l.root_id"


def files(t):
    r = t.root.select(F.col("id").alias("root_id"), F.col("path").alias("root_path"), F.col("name").alias("root_name"), "vendor")
    return t.location.join(r, "root_id").select("asset_id", F.col("abs_path").alias("path"), "root_path", "root_name", "vendor")


def _tag_sql() -> str:
    from .scalars import _FOLDERS, words_sql

    stem = r"regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', '')"
    folders = _FOLDERS.replace("abs_path", "path").replace("r.path", "root_path")
    return f"""with f as ({_FILES}), x as (select asset_id, unnest({words_sql(stem)}) as name, 'heuristic' as source, 0.5::double as confidence from f union all select asset_id, unnest(list_slice({folders}, 1, 2)), 'heuristic', 0.6 from f
        union all select asset_id, 'source:' || root_name, 'structural', null from f) select asset_id, name, source, max(confidence) as confidence from x group by all"""


@query("t1_path_tags", _tag_sql())
def _(t):
    return G.path_tags(files(t))


@query("t2_vendor_tags", f"select distinct asset_id, 'vendor' as name, 'structural' as source from ({_FILES}) where vendor")
def _(t):
    return G.vendor_tags(files(t))


def _link_sql() -> str:
    from .scalars import host_sql, words_sql

    title = "regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        title = f"replace({title}, '{entity}', '{sign}')"
    return f"select page_id as asset_id, 'source:' || {host_sql('url')} as name, 'structural' as source, null::double as confidence from pages union all select page_id, unnest(list_slice({words_sql(title)}, 1, 6)), 'heuristic', 0.5 from pages"


@query("t3_link_tags", _link_sql())
def _(t):
    heads = L.html_head(t.pages, keep=("page_id", "url"))
    return G.link_tags(heads.select(F.col("page_id").alias("asset_id"), "url", F.coalesce(F.try_element_at("head", F.lit("title")), F.lit("")).alias("title")))


_LABELS = """lab as (select case when label < 5 then 'type' else 'style' end as namespace, concat('l', label) as name, label % 5 = 4 as background, x from (select label, list(x order by pos) as x from (select label, pos, avg(x) as x from (select label, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding)::double as x from embeddings) e group by all) m group by 1) p)"""
_SHOT = f"""with {_LABELS}, s as (select e.vec_id as id, l.namespace, l.name, l.background, 100 * list_cosine_similarity(l.x, e.embedding::double[]) as l from embeddings e, lab l), w as (select *, exp(l - max(l) over (partition by id, namespace)) as e from s), p as (select *, e / sum(e) over (partition by id, namespace) as p from w),
    r as (select *, row_number() over (partition by id, namespace order by p desc, name) as r from p), shot as (select id, namespace, name, round(p, 4) as confidence from r where r = 1 and not background and p >= 0.4)"""


def _labels(t):
    ns = F.when(F.col("label") < 5, "type").otherwise("style")
    return G.label_matrix(t.embeddings.select(ns.alias("namespace"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("name"), (F.col("label") % 5 == 4).alias("background"), F.col("embedding").alias("vector")))


@query("t4_zero_shot", f"{_SHOT} select id, namespace, name, confidence from shot")
def _(t):
    return G.zero_shot(_library(t), _labels(t))


@query("t5_label_matrix", f"with {_LABELS} select namespace, name, background, round(list_sum(list_transform(x, lambda v, i: v * i)) / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) as weighted from lab")
def _(t):
    total = F.aggregate(F.transform("q", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return _labels(t).select("namespace", "name", "background", F.round(total, 6).alias("weighted"))


_OLD = "old as (select asset_id, name, case when source = 'manual' then 'manual' when asset_id % 2 = 0 then 'clip' else source end as source, confidence from named_tag where source in ('manual', 'heuristic'))"


@query("t6_retag", f"{_SHOT}, {_OLD} select asset_id, name, source, confidence from old where not (source = 'clip' and asset_id in (select vec_id from embeddings)) union all select id, name, 'clip', confidence from shot")
def _(t):
    source = F.when(F.col("source") == "manual", "manual").when(F.col("asset_id") % 2 == 0, "clip").otherwise(F.col("source"))
    old = t.named_tag.where("source in ('manual', 'heuristic')").select("asset_id", "name", source.alias("source"), "confidence")
    return G.retag(old, _library(t), _labels(t))


@query("t7_put_vectors", "select coalesce(n.asset_id, o.asset_id) as asset_id, coalesce(n.model, o.model) as model, (coalesce(n.vector, o.vector)[1])::double as first from embedding o full join (select asset_id, 'new' as model, list_reverse(vector) as vector from embedding where asset_id % 3 = 0) n on n.asset_id = o.asset_id and n.model = o.model")
def _(t):
    new = t.embedding.where("asset_id % 3 = 0").select("asset_id", F.lit("new").alias("model"), F.reverse("vector").alias("vector"))
    return G.put_vectors(t.embedding, new).select("asset_id", "model", F.col("vector")[0].cast("double").alias("first"))


@query("t8_fact_tags", "select distinct asset_id, case key when 'frame_count' then 'animation' else 'has-alpha' end as name, 'structural' as source from attribute where (key = 'frame_count' and value_num > 1) or (key = 'has_alpha' and value_num > 0)")
def _(t):
    return G.fact_tags(t.attribute)
