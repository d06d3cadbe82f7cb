"""Filters of the catalogue: predicates on an item, and semi or anti joins with its child tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import CLIPPING_DB, SILENT_DB, quantity
from ..functions.text import canonical
from ..sources.shared import settled

# Names of numeric filters and the attribute of each; attributes that "has" asks for.
NUMERIC = {
    "w": "width", "width": "width", "h": "height", "height": "height", "size": "bytes", "bytes": "bytes", "tris": "triangles", "triangles": "triangles",
    "verts": "vertices", "dur": "duration", "duration": "duration", "frames": "frame_count", "cols": "cols", "rows": "rows", "colors": "color_count",
    "rate": "sample_rate", "samplerate": "sample_rate", "channels": "channels", "depth": "bit_depth", "bitrate": "bitrate", "peak": "peak_db", "rms": "rms_db",
}
HAS = {"alpha": "has_alpha", "animation": "animation_count", "rig": "has_rig", "frames": "frame_count"}
COMPARE = {">=": "__ge__", "<=": "__le__", ">": "__gt__", "<": "__lt__", "=": "__eq__"}


def having(items: DataFrame, child: DataFrame, cond: Column | None = None, key: str = "asset_id", negate: bool = False) -> DataFrame:
    """Items with (negate: without) a child row that meets a condition; items are never multiplied."""
    ids = (child if cond is None else child.where(cond)).select(F.col(key).alias("_child"))
    return items.join(ids, items["id"] == F.col("_child"), "left_anti" if negate else "left_semi")


def lacking(items: DataFrame, child: DataFrame, cond: Column | None = None, key: str = "asset_id") -> DataFrame:
    return having(items, child, cond, key, negate=True)


def named_tags(catalog) -> DataFrame:
    """asset_tag with the tag's name and namespace."""
    return catalog.asset_tag.join(catalog.tag.select(F.col("id").alias("tag_id"), "name", "namespace"), "tag_id")


def _literal(text: str) -> Column:
    """A literal through the canonical form, folded by the optimizer."""
    return canonical(F.lit(text))


def by_tag(items: DataFrame, catalog, tag: str, negate: bool = False) -> DataFrame:
    return having(items, named_tags(catalog), F.col("name") == _literal(tag), negate=negate)


def contains(column: str, text: str, negate: bool = False) -> Column:
    """Case-insensitive substring, % and _ as wildcards; a null never passes."""
    test = F.col(column).ilike(f"%{text}%")
    return ~test if negate else test


def by_root(items: DataFrame, catalog, name: str, negate: bool = False) -> DataFrame:
    roots = catalog.root.where((F.col("name") == _literal(name)) | F.col("path").ilike(f"%{name}%")).select(F.col("id").alias("root_id"))
    return having(items, catalog.location.join(roots, "root_id", "left_semi"), negate=negate)


def by_collection(items: DataFrame, catalog, name: str, negate: bool = False) -> DataFrame:
    chosen = catalog.collection.where(F.col("name") == _literal(name)).select(F.col("id").alias("collection_id"))
    return having(items, catalog.collection_asset.join(chosen, "collection_id", "left_semi"), negate=negate)


def attribute_is(key: str, op: str, value: float) -> Column:
    return (F.col("key") == key) & getattr(F.col("value_num"), COMPARE[op])(F.lit(float(value)))


def number_of(text: str | float) -> float | None:
    """A filter's value: a number, or a text with a unit; None if it is neither."""
    if not isinstance(text, str):
        return float(text)
    import re

    from ..functions.numeric import UNITS

    found = re.fullmatch(r"(-?[0-9]*\.?[0-9]+)\s*([A-Za-z]*)", text.strip())
    return float(found[1]) * UNITS[found[2].lower()] if found and found[2].lower() in UNITS else None


def by_number(items: DataFrame, catalog, field: str, op: str, value: str | float, negate: bool = False) -> DataFrame:
    """Items whose attribute compares; a value that is no number, or an unknown field, filters nothing."""
    number = number_of(value)
    if number is None or field not in NUMERIC:
        return items
    return having(items, catalog.attribute, attribute_is(NUMERIC[field], op, number), negate=negate)


def by_has(items: DataFrame, catalog, what: str, negate: bool = False) -> DataFrame:
    """has: caption, license, source, or an attribute above zero; anything else filters nothing."""
    what = what.lower()
    column = {"caption": "caption", "license": "license", "source": "source_url"}.get(what)
    if column:
        test = F.col(column).isNotNull() & (F.col(column) != "")
        return items.where(~test if negate else test)
    return having(items, catalog.attribute, attribute_is(HAS[what], ">", 0), negate=negate) if what in HAS else items


def missing(items: DataFrame, location: DataFrame) -> DataFrame:
    """Items, references aside, without a present location."""
    return lacking(items.where("kind <> 'reference'"), location, F.col("present"))


def by_is(items: DataFrame, catalog, what: str, negate: bool = False) -> DataFrame:
    """is: managed, missing, untagged, vendor, clipping, silent, mono, stereo; anything else filters nothing."""
    what = what.lower()
    if what == "managed":
        return items.where(F.col("managed") != negate)
    if what == "missing":
        return items.join(missing(items, catalog.location).select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti") if negate else missing(items, catalog.location)
    if what == "untagged":
        return having(items, catalog.asset_tag, F.col("source") != "structural", negate=not negate)
    if what == "vendor":
        vendors = catalog.root.where("vendor").select(F.col("id").alias("root_id"))
        return having(items, catalog.location.join(vendors, "root_id", "left_semi"), negate=negate)
    levels = {"clipping": ("peak_db", ">=", CLIPPING_DB), "silent": ("peak_db", "<", SILENT_DB), "mono": ("channels", "=", 1), "stereo": ("channels", "=", 2)}
    return having(items, catalog.attribute, attribute_is(*levels[what]), negate=negate) if what in levels else items


def find(catalog, tags=(), not_tags=(), kind=None, not_kind=None, license=None, not_license=None, source=None, not_source=None, root=None, collection=None, num=(), not_num=(), has=(), not_has=(), is_=(), not_is=()) -> DataFrame:
    """Items that meet all filters. Arguments take one value or several; what is unknown filters nothing.

    A negated filter on a child table asks for no such row; a negated one on a column drops its nulls.
    """
    many = lambda x: [x] if isinstance(x, str) else list(x or ())
    items = catalog.asset
    if kind is not None:
        items = items.where(F.col("kind") == kind.lower())
    if not_kind is not None:
        items = items.where(F.col("kind") != not_kind.lower())
    for column, text, negate in (("license", license, False), ("license", not_license, True), ("source_name", source, False), ("source_name", not_source, True)):
        if text is not None:
            items = items.where(contains(column, text, negate))
    for x in many(has):
        items = by_has(items, catalog, x)
    for x in many(not_has):
        items = by_has(items, catalog, x, negate=True)
    for x in many(is_):
        items = by_is(items, catalog, x)
    for x in many(not_is):
        items = by_is(items, catalog, x, negate=True)
    for x in many(tags):
        items = by_tag(items, catalog, x)
    for x in many(not_tags):
        items = by_tag(items, catalog, x, negate=True)
    if root is not None:
        items = by_root(items, catalog, root)
    if collection is not None:
        items = by_collection(items, catalog, collection)
    for field, op, value in num:
        items = by_number(items, catalog, field, op, value)
    for field, op, value in not_num:
        items = by_number(items, catalog, field, op, value, negate=True)
    return items


def facts(catalog) -> DataFrame:
    """What saved searches ask about: id, field, text and number, one row for each fact of an item."""
    item = catalog.asset
    null = F.lit(None)
    rows = [
        item.select("id", F.lit("kind").alias("field"), F.col("kind").alias("text"), null.cast("double").alias("number")),
        named_tags(catalog).select(F.col("asset_id").alias("id"), F.lit("tag"), "name", null.cast("double")),
        catalog.attribute.where("value_num is not null").select(F.col("asset_id").alias("id"), "key", null.cast("string"), "value_num"),
    ]
    return rows[0].union(rows[1]).union(rows[2])


class _Intervals:
    """The thresholds of each field, sorted, part its numbers into elementary intervals: 2i + 1 is the i-th threshold itself, 2i what lies before it.

    A comparison is a range of intervals, and a number is in one. Ranges are cut into nodes of a binary tree, of which a
    range has about two a level at most, and a number lies below one a level; so numbers meet comparisons by equality
    of nodes, and a row comes out only for a comparison that holds.
    """

    def __init__(self, terms: DataFrame) -> None:
        rows = terms.where(F.col("want").isNotNull()).groupBy("field").agg(F.sort_array(F.collect_set("want")).alias("at")).collect()  # distinct thresholds
        self.at = {r["field"]: r["at"] for r in rows}
        self.levels = max([1, *((2 * len(x) + 1).bit_length() for x in self.at.values())])
        self.spark = terms.sparkSession

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows (field, number) with the interval of their number; those of fields that no term has are left out."""
        known = self.spark.sparkContext.broadcast({f: np.array(x) for f, x in self.at.items()})
        at = [rows.columns.index(c) for c in ("field", "number")]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fields, numbers = np.array(batch.column(at[0]).to_pylist(), dtype=object), batch.column(at[1]).to_numpy(zero_copy_only=False)
                place = np.zeros(len(fields), np.int64)
                for f in set(fields.tolist()):
                    mine = fields == f
                    low, high = (np.searchsorted(known.value[f], numbers[mine], side) for side in ("left", "right"))
                    place[mine] = low + high
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

        kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        return rows.where(F.col("field").isin(*self.at)).mapInArrow(work, f"{kinds}, place long")

    def ranged(self, terms: DataFrame) -> DataFrame:
        """Terms (field, op, want) with the first and last interval in which they hold."""
        exact = terms.where("want is not null").withColumnRenamed("want", "number").transform(self.placed).withColumnRenamed("number", "want")  # 2i + 1, for it is a threshold
        last = F.lit((1 << self.levels) - 1)
        low = F.when(F.col("op") == ">=", F.col("place")).when(F.col("op") == ">", F.col("place") + 1).when(F.col("op").isin("<", "<="), 0).otherwise(F.col("place"))
        high = F.when(F.col("op") == "<=", F.col("place")).when(F.col("op") == "<", F.col("place") - 1).when(F.col("op").isin(">", ">="), last).otherwise(F.col("place"))
        return exact.select(*terms.columns, low.alias("low"), high.alias("high"))

    def nodes(self, terms: DataFrame) -> DataFrame:
        """Terms with (level, node) of the nodes that make up their range: those inside whose parent is not."""
        level = F.explode(F.sequence(F.lit(0), F.lit(self.levels))).alias("level")
        each = terms.select("*", level).withColumns({"_a": F.expr("shiftright(low + shiftleft(1L, level) - 1, level)"), "_b": F.expr("shiftright(high + 1, level) - 1")})  # nodes wholly inside
        ends = F.array_distinct(F.array("_a", "_b"))
        own = F.filter(ends, lambda n: (n >= F.col("_a")) & (n <= F.col("_b")) & ~((F.expr("shiftright(low + shiftleft(1L, level + 1) - 1, level + 1)") <= F.floor(n / 2)) & (F.floor(n / 2) <= F.expr("shiftright(high + 1, level + 1) - 1"))))
        return each.where("_a <= _b").select(*terms.columns, "level", F.explode(own).alias("node"))

    def met(self, terms: DataFrame, placed: DataFrame) -> DataFrame:
        """Terms, with their ranges, and the id of each fact (id, field, place) that meets them: first by interval, then the facts of the intervals."""
        above = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(self.levels)), lambda k: F.call_function("shiftright", F.col("place"), k))).alias("level", "node")
        held = placed.select("field", "place").distinct().select("field", "place", above)  # two for each threshold at most
        return self.nodes(terms).join(held, ["field", "level", "node"]).join(placed, ["field", "place"])

    def counts(self, terms: DataFrame, placed: DataFrame) -> DataFrame:
        """Terms, with their ranges, and n, the number of facts that meet them: a difference of two running sums over the intervals of their field."""
        sizes = placed.groupBy("field", "place").agg(F.count("*").alias("n"))
        asked = terms.select("field", F.explode(F.array(F.col("low") - 1, "high")).alias("place"), F.lit(0).cast("bigint").alias("n"))
        every = sizes.unionByName(asked).groupBy("field", "place").agg(F.sum("n").alias("n"))  # two for each threshold at most
        upto = every.select("field", "place", F.sum("n").over(Window.partitionBy("field").orderBy("place")).alias("n"))
        first = upto.select("field", (F.col("place") + 1).alias("low"), F.col("n").alias("_before"))
        return terms.join(first, ["field", "low"]).join(upto.withColumnRenamed("place", "high"), ["field", "high"]).select(*terms.columns, (F.col("n") - F.col("_before")).alias("n"))


def saved_searches(terms: DataFrame, catalog) -> DataFrame:
    """(query_id, id) for many filter sets at once.

    terms: query_id, field, op (= for kinds and tags), value (text) and negated. An item matches a query when every
    plain term has a fact and no negated one has.

    Of each query the plain term that the fewest facts meet is sought first (how many meet a comparison is counted from
    the sizes of intervals), and only items that meet it are asked for the other terms, by item and field. Numbers
    meet comparisons by intervals; nothing is joined on a field alone. Distinct thresholds are held by the driver and
    every task, 8 bytes each.
    """
    t = terms.select("query_id", "field", "op", "negated", F.when(F.col("field") == "tag", canonical("value")).otherwise(F.col("value")).alias("value"), F.when(~F.col("field").isin("kind", "tag"), quantity("value")).alias("want")).distinct()
    named, numbers = t.where("field in ('kind', 'tag')"), t.where("field not in ('kind', 'tag')")
    rows = facts(catalog)
    texts = rows.where("text is not null").select("id", "field", F.col("text").alias("value"))
    intervals = _Intervals(numbers)
    placed = intervals.placed(rows.where("text is null").select("id", "field", "number")).select("id", "field", "place")
    ranged = settled(intervals.ranged(numbers))
    # how many facts each plain term meets
    counted = intervals.counts(ranged.where("not negated"), placed)
    many = named.where("not negated").join(texts.groupBy("field", "value").agg(F.count("*").alias("n")), ["field", "value"], "left")
    key = ["query_id", "field", "op", "value"]
    every = many.select(*key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).unionByName(counted.select(*key, "n")).unionByName(numbers.where("not negated and want is null").select(*key, F.lit(0).cast("bigint").alias("n")))
    plain = every.groupBy("query_id").agg(F.count("*").alias("terms"), F.min(F.struct("n", "field", "op", "value")).alias("x")).select("query_id", "terms", "x.*").where("n > 0")
    start = settled(plain.select(*key, "terms"))
    by_text = start.join(texts, ["field", "value"]).select("query_id", "id", "terms", "field", "op", "value")
    by_number = intervals.met(ranged.join(start, key), placed).select("query_id", "id", "terms", "field", "op", "value")
    candidates = settled(by_text.unionByName(by_number).distinct())
    # the other terms of each candidate, by item and field
    rest = t.alias("t").join(candidates.alias("c"), (F.col("t.query_id") == F.col("c.query_id")) & ~((F.col("t.field") == F.col("c.field")) & (F.col("t.op") == F.col("c.op")) & (F.col("t.value") == F.col("c.value")) & ~F.col("t.negated"))).select("t.*", "c.id")
    yes_text = rest.where("field in ('kind', 'tag')").join(texts, ["id", "field", "value"], "left_semi")
    yes_number = rest.where("field not in ('kind', 'tag')").join(ranged.select(*key, "negated", "low", "high"), [*key, "negated"]).join(placed, ["id", "field"]).where("place between low and high").select(*yes_text.columns)
    met = yes_text.unionByName(yes_number).groupBy("query_id", "id").agg(F.countDistinct(F.when(~F.col("negated"), F.struct("field", "op", "value"))).alias("met"), F.max("negated").alias("against"))
    found = candidates.join(met, ["query_id", "id"], "left").where("coalesce(met, 0) = terms - 1 and not coalesce(against, false)").select("query_id", "id")
    # queries of negated terms only: each item once, with all of them but those it meets
    only = t.groupBy("query_id").agg(F.bool_and("negated").alias("_only")).where("_only").select("query_id")
    no_text = texts.join(named.join(only, "query_id", "left_semi"), ["field", "value"]).select("query_id", "id")
    no_number = intervals.met(ranged.join(only, "query_id", "left_semi"), placed).select("query_id", "id")
    against = no_text.unionByName(no_number).groupBy("id").agg(F.collect_set("query_id").alias("_no"))
    all_ = only.agg(F.collect_set("query_id").alias("_all")).withColumn("_one", F.lit(1))  # one row: the saved searches of that kind
    left = catalog.asset.select("id", F.lit(1).alias("_one")).join(against, "id", "left").join(F.broadcast(all_), "_one")
    none = F.array().cast(f"array<{dict(terms.dtypes)['query_id']}>")
    return found.unionByName(left.select(F.explode(F.array_except("_all", F.coalesce("_no", none))).alias("query_id"), "id"))


def detail(catalog, ids: DataFrame | None = None) -> DataFrame:
    """Items with their tags (by source, name), locations (present first) and the sets that contain them."""
    items = catalog.asset if ids is None else catalog.asset.join(ids.select("id"), "id", "left_semi")
    struct = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    tags = named_tags(catalog).groupBy("asset_id").agg(struct("source", "name", "namespace", "confidence").alias("tags"))
    places = catalog.location.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct((~F.col("present")).alias("absent"), "id", "abs_path"))).alias("locations"))
    sets = catalog.collection_asset.join(catalog.collection.select(F.col("id").alias("collection_id"), "name"), "collection_id").groupBy("asset_id").agg(F.sort_array(F.collect_list("name")).alias("collections"))
    for child in (tags, places, sets):
        items = items.join(child.withColumnRenamed("asset_id", "id"), "id", "left")
    return items
