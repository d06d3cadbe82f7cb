"""Connected components of an edge table by alternating star contractions, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, shared_folder, written


def least_beside(rows: DataFrame, key: str, value: DataFrame) -> DataFrame:
    """``rows`` with m, the smallest of ``value`` (x, y) for their ``key``.

    A hub's rows are many. A join right above an aggregate on its key is never taken as skewed, one of two shuffles
    is; the key's complement makes Spark shuffle the aggregate once more, for the join, which can then split a hub.
    """
    low = value.groupBy("x").agg(F.min("y").alias("m")).select(F.bitwise_not("x").alias("_x"), "m")
    return rows.join(low, F.bitwise_not(key) == F.col("_x")).drop("_x")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node it is connected with.

    Loops and repeated edges are harmless, an edge with a null end is ignored, no edges give no rows. A hub of
    any degree is a skewed join, which adaptive execution splits (``least_beside``); no group is collected. Rounds
    go on until one changes nothing: their number grows with the square of the logarithm of the nodes at most. A round's
    edges are a table that the next round reads and then removes, so no plan is deeper than a round.
    """
    spark, state, number = edges.sparkSession, None, 0
    folder = shared_folder(spark, "components")
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/{number}")
    while True:
        both = e.union(e.select("v", "u")).toDF("x", "y")
        large = least_beside(both.where("y > x"), "x", both).select(F.col("y").alias("u"), F.least("m", "x").alias("v")).distinct()
        down = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = least_beside(large, "u", large.toDF("x", "y")).select(F.explode(down).alias("e")).select("e.*")
        e = written(small.where("u <> v").distinct(), f"{folder}/{number + 1}")
        removed(spark, f"{folder}/{number}")
        number += 1
        now = e.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
