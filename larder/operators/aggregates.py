"""Counts, summaries and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_db
from .filters import missing, named_tags
from .joins import count_right

#: Buckets of a waveform, and the amplitude from which a bucket clips.
COLUMNS, CLIPPING = 256, 10 ** (-0.1 / 20)


def facets(result: DataFrame, catalog, limit: int | None = None) -> DataFrame:
    """tag, namespace and how many items of a result have it, most first, then by name."""
    tags = named_tags(catalog).join(result.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    counted = tags.groupBy("name", "namespace").agg(F.countDistinct("asset_id").alias("n")).orderBy(F.desc("n"), "name")
    return counted if limit is None else counted.limit(limit)


def kind_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(F.count("*").alias("n"))


def agree(items: DataFrame, columns: list[str]) -> DataFrame:
    """One row: of each column the value that all rows share (null counts as empty), else null."""
    same = lambda c: F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) == 1
    return items.agg(*[F.when(same(c), F.max(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in columns])


def selection_tags(ids: DataFrame, catalog, limit: int = 60) -> DataFrame:
    """Tags of a selection: items that have each, and whether one of them got it by hand."""
    tags = named_tags(catalog).join(ids.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    return tags.groupBy("name").agg(F.countDistinct("asset_id").alias("n"), F.bool_or(F.col("source") == "manual").alias("manual")).orderBy(F.desc("n"), "name").limit(limit)


def collections(catalog) -> DataFrame:
    """Sets with their sizes, empty ones too."""
    return count_right(catalog.collection, catalog.collection_asset, "id", "collection_id", name="size")


def root_counts(catalog) -> DataFrame:
    """Roots with the number of distinct items present under each."""
    return count_right(catalog.root, catalog.location, "id", "root_id", F.col("present"), "asset_id")


def pivot_attrs(attribute: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each item that has one of the attributes, a column for each."""
    return attribute.where(F.col("key").isin(*keys)).groupBy("asset_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value_num"))).alias(k) for k in keys])


def primary_model(embedding: DataFrame) -> DataFrame:
    """The model that most vectors are from; ties go to the first name."""
    return embedding.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(1)


def overview(catalog, model: str) -> DataFrame:
    """One row: items, embedded, outstanding, captioned, missing, with a licence."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    done = catalog.embedding.where(F.col("model") == model).select(F.col("asset_id").alias("_e")).distinct()
    here = catalog.location.where("present").select(F.col("asset_id").alias("_l")).distinct()
    rows = catalog.asset.join(done, F.col("id") == F.col("_e"), "left").join(here, F.col("id") == F.col("_l"), "left")
    embedded, present = F.col("_e").isNotNull(), F.col("_l").isNotNull()
    return rows.agg(
        F.count("*").alias("items"), F.count_if(embedded).alias("embedded"), F.count_if(F.col("kind").isin("image", "model3d") & ~embedded & present).alias("outstanding"),
        F.count_if(filled("caption")).alias("captioned"), F.count_if((F.col("kind") != "reference") & ~present).alias("missing"), F.count_if(filled("license")).alias("licensed"),
    )


def tag_usage(catalog) -> DataFrame:
    """The tag vocabulary with the number of items of each tag, zero kept."""
    return count_right(catalog.tag, catalog.asset_tag, "id", "tag_id", distinct="asset_id")


def loudness(samples: DataFrame, full_scale: float = 1.0) -> DataFrame:
    """series_id, peak_db and rms_db of samples (series_id, i, value); an empty series has the floor."""
    v = F.col("value").cast("double") / full_scale
    return samples.groupBy("series_id").agg(to_db(F.coalesce(F.max(F.abs(v)), F.lit(0.0))).alias("peak_db"), to_db(F.coalesce(F.sqrt(F.avg(v * v)), F.lit(0.0))).alias("rms_db"))


def envelope(samples: DataFrame, columns: int = COLUMNS, full_scale: float = 1.0) -> DataFrame:
    """Lowest and highest value of each of at most ``columns`` buckets of a series, and whether the bucket clips.

    Bucket c of n samples begins at int(c n / columns); i counts from 0 without gaps.
    """
    sizes = samples.groupBy("series_id").agg(F.count("*").alias("n"))
    wide = samples.join(sizes, "series_id").withColumn("k", F.least(F.col("n"), F.lit(columns)))
    # the last bucket whose first sample is not beyond i
    bucket = F.floor(((F.col("i") + 1) * F.col("k") - 1) / F.col("n")).cast("bigint")
    v = F.col("value").cast("double") / full_scale
    out = wide.groupBy("series_id", bucket.alias("bucket")).agg(F.greatest(F.lit(-1.0), F.least(F.min(v), F.lit(0.0))).alias("low"), F.least(F.lit(1.0), F.greatest(F.max(v), F.lit(0.0))).alias("high"))
    return out.withColumn("clips", F.greatest(F.col("high"), -F.col("low")) >= CLIPPING)


def prototypes(vectors: DataFrame, by: list[str], column: str = "vector") -> DataFrame:
    """The mean vector of each group, of unit length; components are averaged where they are, then put in order."""
    each = vectors.select(*by, F.posexplode(column).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("m")).withColumn("m", F.transform("m", lambda s: s["x"]))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(*by, F.transform("m", lambda x: x / F.when(size > 0, size).otherwise(1.0)).alias("vector"))


def extent(points: DataFrame, by: str = "mesh_id") -> DataFrame:
    """Size along each axis (4 places) and the vertices and triangles of groups of points (x, y, z, triangles)."""
    span = lambda c: F.round(F.max(c) - F.min(c), 4)
    return points.groupBy(by).agg(span("x").alias("size_x"), span("y").alias("size_y"), span("z").alias("size_z"), F.count("*").alias("vertices"), F.sum("triangles").cast("bigint").alias("triangles"))


def text_docs(catalog, ids: DataFrame | None = None) -> DataFrame:
    """What text search indexes: id, title, notes, filename (distinct, by first location), caption, tags (sorted); of all items or of some (id)."""
    only = (lambda rows, key: rows) if ids is None else (lambda rows, key: rows.join(ids.select(F.col("id").alias(key)), key, "left_semi"))
    name = F.regexp_extract("abs_path", "[^/]*$", 0)
    files = only(catalog.location, "asset_id").select("asset_id", "id", name.alias("file")).groupBy("asset_id", "file").agg(F.min("id").alias("id")).groupBy("asset_id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("id", "file"))), lambda s: s["file"])).alias("filename"))
    tags = only(named_tags(catalog), "asset_id").groupBy("asset_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("name"))).alias("tags"))
    rows = only(catalog.asset, "id").select("id", "title", "notes", "caption").join(files.withColumnRenamed("asset_id", "id"), "id", "left").join(tags.withColumnRenamed("asset_id", "id"), "id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("id", text("title"), text("notes"), text("filename"), text("caption"), text("tags"))


__all__ = ["agree", "collections", "envelope", "extent", "facets", "kind_counts", "loudness", "missing", "overview", "pivot_attrs", "primary_model", "prototypes", "root_counts", "selection_tags", "tag_usage", "text_docs"]
