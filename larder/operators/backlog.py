"""Work outstanding, as views over the catalogue and a log of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import BOX
from .aggregates import pivot_attrs
from .filters import having, lacking, named_tags

#: Kinds with something to see; tags of pictures that are data; failures before work is left alone.
SEEN, DATA_TAGS, ATTEMPTS = ("image", "model3d"), ("normal-map",), 3


def pending_vectors(catalog, model: str, limit: int | None = None) -> DataFrame:
    """Items to embed: of a kind that can be seen, present, and without a vector of the model; by id."""
    items = having(catalog.asset.where(F.col("kind").isin(*SEEN)), catalog.location, F.col("present"))
    rows = lacking(items, catalog.embedding, F.col("model") == model).select("id", "kind").orderBy("id")
    return rows if limit is None else rows.limit(limit)


def pending_tiles(catalog, tiles: DataFrame, box: int = BOX) -> DataFrame:
    """Items to render: present, no reference, no tile (content_hash), and not a picture that fits the box as it is."""
    items = having(catalog.asset.where("kind <> 'reference'"), catalog.location, F.col("present"))
    items = items.join(tiles.select("content_hash"), "content_hash", "left_anti")
    size = pivot_attrs(catalog.attribute, ["width", "height"]).withColumnRenamed("asset_id", "id")
    skip = (F.col("kind") == "image") & (F.greatest(F.col("width").cast("bigint"), F.col("height").cast("bigint")) <= box) & F.col("width").isNotNull() & F.col("height").isNotNull()
    return items.join(size, "id", "left").where(~F.coalesce(skip, F.lit(False))).select("id", "kind", "content_hash")


def pending_captions(catalog, wanted: DataFrame, redo: bool = False, limit: int | None = None) -> DataFrame:
    """Of items wanted (id, ord) those to caption: seen, present, no data picture, and no caption unless redone; the limit counts them only."""
    items = catalog.asset.where(F.col("kind").isin(*SEEN))
    if not redo:
        items = items.where("caption is null or caption = ''")
    items = lacking(having(items, catalog.location, F.col("present")), named_tags(catalog), F.col("name").isin(*DATA_TAGS))
    rows = wanted.join(items.select("id"), "id", "left_semi").orderBy("ord", "id")
    return rows if limit is None else rows.limit(limit)


def fold_attempts(log: DataFrame) -> DataFrame:
    """(key, state, attempts) from a log (key, ts, seq, outcome: success, failure, requeue) in order of ts and seq.

    A requeue starts anew; the last success or failure since decides: done, pending below ATTEMPTS failures, failed
    from then on. Keys are folded by grouped counts around their last requeue, not by replaying rows in one task.
    """
    at = F.struct("ts", "seq")
    marks = log.where("outcome = 'requeue'").groupBy("key").agg(F.max(at).alias("since"))
    rows = log.where("outcome in ('success', 'failure')").join(marks, "key", "left").where(F.col("since").isNull() | (at > F.col("since")))
    last = rows.groupBy("key").agg(F.count_if(F.col("outcome") == "failure").alias("attempts"), F.max_by("outcome", at).alias("last"))
    every = log.select("key").distinct().join(last, "key", "left")
    attempts = F.coalesce("attempts", F.lit(0))
    return every.select("key", F.when(F.col("last") == "success", "done").when(attempts >= ATTEMPTS, "failed").otherwise("pending").alias("state"), attempts.alias("attempts"))


def work_status(folded: DataFrame) -> DataFrame:
    """How many keys are in each state."""
    return folded.groupBy("state").agg(F.count("*").alias("n"))


__all__ = ["Window", "fold_attempts", "pending_captions", "pending_tiles", "pending_vectors", "work_status"]
