"""Edits as set operations: each returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical
from .ranking import append_members, placed

#: Tags of a bulk edit that are gathered in one row.
TAGS = 1024
# Sources of a tag; those that a rescan replaces; columns that an edit may set.
SOURCES = ("structural", "heuristic", "clip", "vlm", "manual", "imported")
AUTOMATED = ("structural", "heuristic", "clip", "vlm")
EDITABLE = ("title", "notes", "caption", "source_url", "source_name", "license")
_KEY = ["asset_id", "tag_id", "source"]


def add_tags(asset_tag: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table with rows of another (asset_id, tag_id, source, confidence, ...) that it lacks, and the rows added.

    A row of an unknown source raises when the table is used.
    """
    known = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("unknown tag source "), F.col("source"))))
    added = new.withColumn("source", known).dropDuplicates(_KEY).join(asset_tag.select(*_KEY), _KEY, "left_anti")
    return asset_tag.unionByName(added.select(*asset_tag.columns)), added


def remove_tags(asset_tag: DataFrame, drop: DataFrame, source: str = "manual") -> DataFrame:
    """The table without tags (asset_id, tag_id) of one source."""
    return asset_tag.join(drop.select("asset_id", "tag_id", F.lit(source).alias("source")), _KEY, "left_anti")


def bulk_tags(asset_tag: DataFrame, selection: DataFrame, add: DataFrame, remove: DataFrame, source: str = "manual") -> DataFrame:
    """Tags (tag_id) added to and removed from each item (id) of a selection, in one plan."""
    ids = selection.select(F.col("id").alias("asset_id")).distinct()

    def pairs(tags: DataFrame) -> DataFrame:
        """Every item with every tag, which is what the edit writes: the tags come in rows of TAGS and are unfolded beside the item."""
        tags = tags.select("tag_id").where("tag_id is not null").distinct()
        blocks = max(1, -(-tags.count() // TAGS))
        rows = tags.groupBy(F.pmod(F.xxhash64("tag_id"), F.lit(blocks)).alias("_b")).agg(F.collect_list("tag_id").alias("_tags"))
        met = ids.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(rows, "_b")
        return met.select("asset_id", F.explode("_tags").alias("tag_id"))

    new = pairs(add).withColumns({"source": F.lit(source), "confidence": F.lit(None).cast("double"), "created_at": F.lit(None).cast("timestamp_ntz")})
    kept = remove_tags(asset_tag, pairs(remove), source)
    return add_tags(kept, new.select(*[c for c in asset_tag.columns if c in new.columns]))[0]


def edit_fields(items: DataFrame, ids: DataFrame, stamp: Column, **fields: str | None) -> DataFrame:
    """Items with the editable fields of some of them set; other names are ignored, and with many items the title too."""
    chosen = ids.select(F.col("id").alias("_sel")).distinct()
    bulk = chosen.limit(2).count() > 1
    values = {k: v for k, v in fields.items() if k in EDITABLE and not (bulk and k == "title")}
    rows = items.join(chosen, F.col("id") == F.col("_sel"), "left")
    hit = F.col("_sel").isNotNull()
    if values:
        rows = rows.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()} | {"updated_at": F.when(hit, stamp).otherwise(F.col("updated_at"))})
    return rows.select(*items.columns)


def add_to_set(members: DataFrame, collection_id: int, ids: DataFrame, found: DataFrame) -> DataFrame:
    """A set with listed items (id, ord), then a query's (id, rank), behind its members."""
    listed = ids.select("id", F.struct(F.lit(0).alias("a"), F.col("ord").cast("bigint").alias("b")).alias("ord"))
    rest = found.select("id", F.struct(F.lit(1).alias("a"), F.col("rank").cast("bigint").alias("b")).alias("ord"))
    new = listed.union(rest).select(F.lit(collection_id).cast("bigint").alias("collection_id"), F.col("id").alias("asset_id"), "ord")
    return append_members(members, new)


def create_set(collection: DataFrame, names: DataFrame) -> DataFrame:
    """Sets with new ones (name, notes) by canonical name; empty and known names add nothing. Ids go on from the largest, by name."""
    fresh = names.select(canonical("name").alias("name"), "notes").where("name <> ''").groupBy("name").agg(F.min("notes").alias("notes")).join(collection, "name", "left_anti")
    last = collection.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    numbered = placed(fresh, F.asc("name"), name="_i").join(F.broadcast(last)).withColumn("id", (F.col("_last") + F.col("_i")).cast("bigint"))
    return collection.unionByName(numbered.select("id", "name", "notes"), allowMissingColumns=True)


def update_set(collection: DataFrame, collection_id: int, name: str | None = None, notes: str | None = None) -> DataFrame:
    hit = F.col("id") == collection_id
    out = collection
    if name is not None:
        new = canonical(F.lit(name))
        out = out.withColumn("name", F.when(hit & (new != ""), new).otherwise(F.col("name")))
    return out if notes is None else out.withColumn("notes", F.when(hit, F.lit(notes)).otherwise(F.col("notes")))


def delete_set(collection: DataFrame, members: DataFrame, collection_id: int) -> tuple[DataFrame, DataFrame]:
    """Sets and memberships without one set; items stay."""
    return collection.where(F.col("id") != collection_id), members.where(F.col("collection_id") != collection_id)
