"""Incremental sync: a snapshot of files against the catalogue, by diff, upsert and soft delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import missing
from .joins import merge_keyed, owner_root
from .ranking import placed
from .sets import AUTOMATED


def needs_hash(listing: DataFrame, location: DataFrame, rehash: bool = False) -> DataFrame:
    """Files (path, size, mtime) that are new or whose size or time differs; all of them if asked to rehash."""
    if rehash:
        return listing
    known = location.select(F.col("abs_path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    same = (F.col("path") == F.col("_p")) & F.col("size").eqNullSafe(F.col("_s")) & F.col("mtime").eqNullSafe(F.col("_m"))
    return listing.join(known, same, "left_anti")


def classify(listing: DataFrame, asset: DataFrame, location: DataFrame) -> DataFrame:
    """Files (path, content_hash, ...) with asset_id and status: added, relinked, updated, unchanged.

    Content never seen is added even at a known path; a known path whose content became another item's is updated.
    """
    a = asset.select(F.col("content_hash").alias("_h"), F.col("id").alias("asset_id"))
    p = location.select(F.col("abs_path").alias("_p"), F.col("asset_id").alias("_old"))
    rows = listing.join(a, F.col("content_hash") == F.col("_h"), "left").join(p, F.col("path") == F.col("_p"), "left")
    status = F.when(F.col("asset_id").isNull(), "added").when(F.col("_p").isNull(), "relinked").when(F.col("_old") != F.col("asset_id"), "updated").otherwise("unchanged")
    return rows.withColumn("status", status).drop("_h", "_p", "_old")


def new_assets(listing: DataFrame, asset: DataFrame, stamp: Column | None = None) -> DataFrame:
    """An item for each new content of a listing (path, content_hash, kind, title, mode): the first path names it.

    Ids go on from the largest in the order of the contents, numbered in as many parts as they need.
    """
    first = Window.partitionBy("content_hash").orderBy("path")
    fresh = listing.join(asset.select("content_hash"), "content_hash", "left_anti").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    last = asset.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_last"))  # one row
    numbered = placed(fresh.select("kind", "content_hash", "title", "mode"), F.asc("content_hash"), name="_i").join(F.broadcast(last))
    rows = numbered.select((F.col("_last") + F.col("_i")).cast("bigint").alias("id"), "kind", "content_hash", "title", (F.col("mode") == "managed").alias("managed"))
    return rows if stamp is None else rows.withColumns({"added_at": stamp, "updated_at": stamp})


def upsert_locations(old: DataFrame, new: DataFrame, stamp: Column) -> DataFrame:
    """Locations by path: those seen (abs_path, asset_id, root_id, size, mtime) are present with a new last_seen, absent ones return."""
    seen = new.withColumns({"last_seen": stamp, "present": F.lit(True)})
    columns = ["abs_path", "asset_id", "root_id", "size", "mtime", "last_seen", "present"]
    return merge_keyed(old.select(*columns), seen.select(*columns), "abs_path")


def mark_absent(location: DataFrame, started: Column, roots: DataFrame) -> DataFrame:
    """Locations with present unset for those under a scanned root (id) that were last seen before the scan."""
    scanned = location.join(roots.select(F.col("id").alias("_root")), F.col("root_id") == F.col("_root"), "left")
    gone = F.col("present") & F.col("_root").isNotNull() & (F.col("last_seen") < started)
    return scanned.withColumn("present", F.col("present") & ~F.coalesce(gone, F.lit(False))).select(*location.columns)


def sync_stats(classified: DataFrame) -> DataFrame:
    """Counts of each root from files with root_id, status, hashed, error."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return classified.groupBy("root_id").agg(F.count("*").alias("seen"), *[count(s) for s in ("added", "relinked", "updated", "unchanged")], F.count_if("hashed").alias("hashed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def sync_roots(old: DataFrame, config: DataFrame) -> DataFrame:
    """Roots by path with the configured ones' settings; those no longer configured are disabled, not deleted."""
    o, c = old.alias("o"), config.alias("c")
    both = o.join(c, F.col("o.path") == F.col("c.path"), "full_outer")
    keep = [F.coalesce(f"c.{x}", f"o.{x}").alias(x) for x in ("path", "name", "mode", "recursive", "vendor")]
    return both.select(F.col("o.id").alias("id"), *keep, F.coalesce(F.col("c.enabled"), F.lit(False)).alias("enabled"))


def prune(catalog, dry_run: bool = True) -> dict[str, DataFrame] | DataFrame:
    """Items with no present location: as a preview, or as every table without them."""
    gone = missing(catalog.asset, catalog.location).select("id", "title")
    if dry_run:
        return gone
    ids = gone.select(F.col("id").alias("asset_id"))
    children = ("asset_tag", "attribute", "phash", "embedding", "collection_asset", "location")
    out = {name: getattr(catalog, name).join(ids, "asset_id", "left_anti") for name in children if getattr(catalog, name, None) is not None}
    return out | {"asset": catalog.asset.join(gone.select("id"), "id", "left_anti")}


def reprobe(asset_tag: DataFrame, attribute: DataFrame, seen: DataFrame, facts: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags and attributes with those of the items seen (asset_id) replaced once; manual and imported tags stay."""
    ids = seen.select("asset_id").distinct()
    replaced = ids.join(F.broadcast(asset_tag.sparkSession.createDataFrame([(s,) for s in AUTOMATED], "source string")))
    kept = asset_tag.join(replaced, ["asset_id", "source"], "left_anti")
    key = ["asset_id", "name", "source"]
    merged = kept.select(*key, "confidence").union(tags.join(ids, "asset_id", "left_semi").select(*key, "confidence"))
    merged = merged.groupBy(*key).agg(F.max("confidence").alias("confidence"))
    cols = ["asset_id", "key", "value_text", "value_num"]
    values = attribute.join(ids, "asset_id", "left_anti").select(*cols).union(facts.join(ids, "asset_id", "left_semi").select(*cols))
    return merged, values


def to_attributes(wide: DataFrame, key: str = "asset_id") -> DataFrame:
    """(asset_id, key, value_text, value_num) of a wide table: numbers and flags apart from texts, nulls left out."""
    kinds = dict(wide.dtypes)
    number = lambda c: kinds[c] in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
    cell = lambda c: F.struct(F.lit(c).alias("key"), (F.lit(None).cast("string") if number(c) else F.col(c).cast("string")).alias("value_text"), (F.col(c).cast("double") if number(c) else F.lit(None).cast("double")).alias("value_num"))
    rows = wide.select(F.col(key).alias("asset_id"), F.explode(F.array(*[cell(c) for c in wide.columns if c != key])).alias("x")).select("asset_id", "x.*")
    return rows.where("value_text is not null or value_num is not null")


__all__ = ["classify", "mark_absent", "missing", "needs_hash", "new_assets", "owner_root", "prune", "reprobe", "sync_roots", "sync_stats", "to_attributes", "upsert_locations"]
