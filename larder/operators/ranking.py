"""Orders, pages and best-of lists; every order ends with the id, so it is the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .aggregates import pivot_attrs
from .joins import nearest
from .neighbours import VectorCells, hash_neighbours

#: Rows that one task numbers.
ONE_TASK = 200_000


def sort_keys(by: str) -> list[Column]:
    """The order of items by added, updated, name (case aside), size (largest location; a column max_size) or relevance (a column score)."""
    keys = {"added": F.desc("added_at"), "updated": F.desc("updated_at"), "name": F.asc(F.lower("title")), "size": F.desc_nulls_last("max_size"), "relevance": F.asc_nulls_last("score")}
    return [keys[by], F.asc("id")]


def order(items: DataFrame, by: str = "added") -> DataFrame:
    """Items in the order of ``sort_keys``."""
    return items.orderBy(*sort_keys(by))


def placed(rows: DataFrame, *keys: Column, name: str = "rank") -> DataFrame:
    """Rows with their place in a whole order, from 1; the keys must leave no ties.

    More rows than ONE_TASK are ranged by Spark over as many parts as they need, each sorted by itself; a place is the
    one within the part raised by the sizes of the parts before, one number a part. Ties of a first key are parted by
    the keys that follow, so no value has a task to itself.
    """
    rows = settled(rows)
    parts = -(-rows.count() // ONE_TASK)
    if parts <= 1:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
    ranged = settled(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the id's upper bits number the part, its lower ones the row within
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each part
    return out.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint").alias(name))


def with_size(items: DataFrame, location: DataFrame) -> DataFrame:
    """Items with the size of their largest location."""
    sizes = location.groupBy(F.col("asset_id").alias("_a")).agg(F.max("size").alias("max_size"))
    return items.join(sizes, F.col("id") == F.col("_a"), "left").drop("_a")


def primary_location(location: DataFrame, present_only: bool = False) -> DataFrame:
    """One location of each item: a present one first, then the lowest id."""
    rows = location.where("present") if present_only else location
    rank = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("present"), "id"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def decorate(items: DataFrame, catalog, keys: list[str]) -> DataFrame:
    """Items, as of a page, with some attributes as columns, the path and presence of their primary location, and their largest size."""
    ids = items.select(F.col("id").alias("asset_id"))
    location = catalog.location.join(ids, "asset_id", "left_semi")
    place = primary_location(location).select(F.col("asset_id").alias("id"), "abs_path", "present")
    wide = pivot_attrs(catalog.attribute.join(ids, "asset_id", "left_semi"), keys).withColumnRenamed("asset_id", "id")
    return with_size(items, location).join(place, "id", "left").join(wide, "id", "left")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return rows.offset(offset).limit(limit)


def best(scored: DataFrame, k: int, keys: list[Column], by: str = "query_id") -> DataFrame:
    """The first k rows of each query by keys, with their rank."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*keys))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def top_k(queries: DataFrame, library: DataFrame | VectorCells, k: int = 60, floor: float = 0.0) -> DataFrame:
    """query_id, id, score, rank of the k library rows (id, v) nearest by cosine to each query (query_id, q) but itself.

    The floor is applied after the k best are taken. Vectors of another length, null or zero ones, have no score. A task
    sends k rows a query, so what is ranked does not grow with the library. Of stored cells only those are read that
    can hold one of the k.
    """
    near = library.nearest(queries, k)[0] if isinstance(library, VectorCells) else nearest(queries, library, k)
    return best(near, k, [F.desc("score"), F.asc("id")]).where(F.col("score") >= floor)


def similar_by_hash(queries: DataFrame, library: DataFrame, k: int = 60, most: int = 32) -> DataFrame:
    """query_id, id, distance, rank of the k hashes (id, v) nearest to each query (query_id, q) within ``most`` bits."""
    return hash_neighbours(queries, library, k, most).select("query_id", "id", "distance", "rank")


def append_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """A set table with items (collection_id, asset_id, ord) added behind the last position, by ord; members keep their place.

    Positions are numbered within each set, never over all sets.
    """
    once = new.groupBy("collection_id", "asset_id").agg(F.min("ord").alias("ord")).join(members, ["collection_id", "asset_id"], "left_anti")
    last = members.groupBy("collection_id").agg(F.max("position").alias("last"))
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy("ord", "asset_id"))
    added = once.join(last, "collection_id", "left").select("collection_id", "asset_id", (F.coalesce("last", F.lit(-1)) + place).cast("bigint").alias("position"))
    return members.select("collection_id", "asset_id", "position").union(added)


def set_members(catalog, collection_id: int) -> DataFrame:
    return catalog.collection_asset.where(F.col("collection_id") == collection_id).orderBy("position")


def remove_members(members: DataFrame, drop: DataFrame) -> DataFrame:
    return members.join(drop, ["collection_id", "asset_id"], "left_anti")


def containing(catalog, ids: DataFrame) -> DataFrame:
    """(asset_id, collection_id, name) of the sets that contain some items."""
    return catalog.collection_asset.join(ids.select(F.col("id").alias("asset_id")), "asset_id", "left_semi").join(catalog.collection.select(F.col("id").alias("collection_id"), "name"), "collection_id").select("asset_id", "collection_id", "name")


def suggest(usage: DataFrame, text: str, limit: int = 12) -> DataFrame:
    """Tags (name, n) that contain a text: those that begin with it first, then the most used, then by name."""
    hit = usage.where(F.contains("name", F.lit(text.lower())))
    return hit.orderBy(F.desc(F.startswith("name", F.lit(text.lower()))), F.desc("n"), "name").limit(limit)


def by_rank(items: DataFrame, ranking: DataFrame) -> DataFrame:
    """Items of a ranking (id, rank), in its order."""
    return items.join(ranking.select("id", "rank"), "id").orderBy("rank", "id")


def dominant(values: DataFrame, by: str, value: str, n: int = 8) -> DataFrame:
    """The n most frequent values of each group in an array, short ones filled by repeating from the front."""
    counted = values.groupBy(by, value).agg(F.count("*").alias("_n"))
    first = best(counted, n, [F.desc("_n"), F.asc(value)], by)
    listed = first.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", value))), lambda s: s[value]).alias("v"))
    return listed.select(by, F.slice(F.flatten(F.array_repeat("v", n)), 1, n).alias("dominant"))
