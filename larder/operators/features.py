"""Numeric detectors over pixels, rows of values and series, as grouped Spark jobs.

Pixels are a long table (asset_id, y, x, r, g, b, a) without gaps; series are (series_id, i, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Colours counted; pixels analysed; opacity; and the thresholds of each detector.
MOST_COLOURS, MOST_PIXELS, OPAQUE = 4096, 16 * 1024 * 1024, 16
SEAM, COVERAGE, BORDER = 1.5, 0.95, 0.25
NATIVE_EDGE, NATIVE_COLOURS, LEAST_BLOCKS, FLAT_BLOCK = 128, 64, 8, 8.0
PEAK, FUNDAMENTAL, LAGS = 0.2, 0.9, (2, 32)
RGB = ("r", "g", "b")
#: Pictures whose facts are broadcast; the facts of more are met by a shuffle.
HELD = 200_000


def raster_facts(pixels: DataFrame) -> DataFrame:
    """Size, aspect, alpha and colours of each picture; those beyond MOST_PIXELS have no colours."""
    size = pixels.groupBy("asset_id").agg((F.max("x") + 1).cast("bigint").alias("width"), (F.max("y") + 1).cast("bigint").alias("height"), F.bool_or(F.col("a") < 255).alias("has_alpha"), F.countDistinct("r", "g", "b", "a").alias("n"))
    small = F.col("width") * F.col("height") <= MOST_PIXELS
    return size.select("asset_id", "width", "height", F.round(F.col("width") / F.col("height"), 4).alias("aspect"), "has_alpha", F.when(small, F.least("n", F.lit(MOST_COLOURS))).cast("bigint").alias("color_count"))


def dhash(grid: DataFrame) -> DataFrame:
    """(asset_id, dhash) of grids (asset_id, y, x, value) of 8 rows: a bit is set where a cell is brighter than its left one, rows first, high bit first."""
    left = F.lag("value").over(Window.partitionBy("asset_id", "y").orderBy("x"))
    bits = grid.withColumn("bit", (F.col("value") > left).cast("bigint")).where("bit is not null")
    width = F.max("x").over(Window.partitionBy("asset_id"))
    place = (8 * width - 1 - (F.col("y") * width + F.col("x") - 1)).cast("int")
    placed = bits.select("asset_id", F.when(F.col("bit") == 1, F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint")).alias("v"))
    return placed.groupBy("asset_id").agg(F.bit_or("v").alias("dhash"))


def _steps(pixels: DataFrame) -> DataFrame:
    """Pixels with the mean absolute step of their colours from the pixel above (dy) and to the left (dx)."""
    above, left = Window.partitionBy("asset_id", "x").orderBy("y"), Window.partitionBy("asset_id", "y").orderBy("x")
    gap = lambda w: sum(F.abs(F.col(c) - F.lag(c).over(w)).cast("double") for c in RGB) / 3
    return pixels.withColumns({"dy": gap(above), "dx": gap(left)})


def seams(pixels: DataFrame) -> DataFrame:
    """seam_score (wrap step over interior step; null if flat), border contrast, and opaque share of each picture."""
    size = Window.partitionBy("asset_id")
    rows = _steps(pixels.withColumns({"w": F.max("x").over(size), "h": F.max("y").over(size)}))
    first_last = lambda axis, other: (
        rows.where((F.col(axis) == 0) | (F.col(axis) == F.col({"x": "w", "y": "h"}[axis]))).groupBy("asset_id", other)
        .agg(sum(F.abs(F.max(F.when(F.col(axis) == 0, F.col(c))) - F.max(F.when(F.col(axis) != 0, F.col(c)))).cast("double") for c in RGB).alias("s"), F.count("*").alias("n"))
        .where("n = 2").groupBy("asset_id").agg((F.avg("s") / 3).alias(f"wrap_{axis}"))
    )
    edge = lambda cond, step: F.avg(F.when(cond, F.col(step)))
    inner = rows.groupBy("asset_id").agg(
        F.avg("dy").alias("my"), F.avg("dx").alias("mx"), F.avg((F.col("a") >= OPAQUE).cast("double")).alias("opaque"),
        ((edge(F.col("y") == 0, "dx") + edge(F.col("y") == F.col("h"), "dx") + edge(F.col("x") == 0, "dy") + edge(F.col("x") == F.col("w"), "dy")) / 4).alias("edge"),
    )
    both = inner.join(first_last("y", "x"), "asset_id").join(first_last("x", "y"), "asset_id")
    inside = F.col("my") + F.col("mx")
    return both.select("asset_id", F.when(inside > 1e-9, (F.col("wrap_y") + F.col("wrap_x")) / inside).alias("seam_score"), F.when(inside > 1e-9, F.col("edge") / (inside / 2)).otherwise(0.0).alias("border"), "opaque")


def tileable(pixels: DataFrame) -> DataFrame:
    """(asset_id, seam_score, name, confidence) of pictures whose edges join unseen."""
    hit = seams(pixels).where((F.col("opaque") >= COVERAGE) & (F.col("seam_score") <= SEAM) & (F.col("border") >= BORDER))
    return hit.select("asset_id", F.round("seam_score", 3).alias("seam_score"), F.lit("tileable").alias("name"), F.lit(0.8).alias("confidence"))


def normal_map(pixels: DataFrame) -> DataFrame:
    """(asset_id, name, confidence) of pictures with the colours of a normal map."""
    stats = pixels.groupBy("asset_id").agg(*[F.avg(c).alias(c) for c in RGB], F.avg(((F.col("b") >= F.col("r")) & (F.col("b") >= F.col("g"))).cast("double")).alias("blue"))
    middle = lambda c: (F.col(c) > 96) & (F.col(c) < 160)
    return stats.where((F.col("b") > 200) & middle("r") & middle("g") & (F.col("blue") >= 0.9)).select("asset_id", F.lit("normal-map").alias("name"), F.lit(0.9).alias("confidence"))


def mask(pixels: DataFrame) -> DataFrame:
    """(asset_id, name, confidence) of pictures in two tones of grey; 256 levels a picture at most."""
    spread = (F.greatest(*RGB) - F.least(*RGB)).cast("double")
    levels = pixels.groupBy("asset_id", "r").agg(F.count("*").alias("n"), F.sum(spread).alias("s"))
    rank = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("n"), "r"))
    stats = levels.withColumn("k", rank).groupBy("asset_id").agg((F.sum("s") / F.sum("n")).alias("saturation"), (F.sum(F.when(F.col("k") <= 2, F.col("n"))) / F.sum("n")).alias("share"))
    return stats.where("saturation <= 2 and share >= 0.9").select("asset_id", F.lit("mask").alias("name"), F.lit(0.7).alias("confidence"))


def _met(pixels: DataFrame, facts: DataFrame) -> DataFrame:
    """Pixels with the facts (asset_id, ...) of their picture, one row each; pixels of pictures without any go.

    Spark guesses the size of pixels by that of what they are made from, a thousandth of it or less, and would hold them
    whole. So it is told to hold the facts.
    """
    facts = settled(facts)
    return pixels.join(facts.hint("broadcast" if facts.count() <= HELD else "shuffle_hash"), "asset_id")


def _cells(pixels: DataFrame, axis: str) -> DataFrame:
    """(asset_id, cells) along one axis: the largest divisor whose inner boundaries are all empty before or all empty after."""
    used = pixels.groupBy("asset_id", F.col(axis).alias("p")).agg(F.bool_or(F.col("a") >= OPAQUE).alias("used"))
    length = used.groupBy("asset_id").agg((F.max("p") + 1).cast("int").alias("length"))
    most = F.least(F.lit(64), F.floor(F.col("length") / 4)).cast("int")
    tries = length.select("asset_id", "length", F.explode(F.when(most >= 2, F.sequence(F.lit(2), most)).otherwise(F.array().cast("array<int>"))).alias("cells")).where("length % cells = 0")
    bounds = tries.select("asset_id", "cells", F.explode(F.sequence(F.lit(1), F.col("cells") - 1)).alias("k"), (F.col("length") / F.col("cells")).cast("int").alias("cell"))
    sides = bounds.select("asset_id", "cells", F.explode(F.array(F.lit(0), F.lit(-1))).alias("side"), "k", "cell").withColumn("p", F.col("k") * F.col("cell") + F.col("side"))
    free = sides.join(used.hint("merge"), ["asset_id", "p"]).groupBy("asset_id", "cells", "side").agg((~F.bool_or("used")).alias("free")).where("free")
    return length.join(free.groupBy("asset_id").agg(F.max("cells").alias("cells")), "asset_id", "left").select("asset_id", F.coalesce("cells", F.lit(1)).alias("cells"), "length")


def sprite_grid(pixels: DataFrame) -> DataFrame:
    """(asset_id, cols, rows, frames, name, confidence) of sheets: cells parted by empty lines, enough of them filled."""
    cols, rows = (_cells(pixels, a).select("asset_id", F.col("cells").alias(n), F.col("length").alias(f"{n}_l")) for a, n in (("x", "cols"), ("y", "rows")))
    grid = cols.join(rows, "asset_id").where("cols * rows >= 2")
    at = lambda axis, n: F.floor(F.col(axis) / (F.col(f"{n}_l") / F.col(n)).cast("int"))
    ink = _met(pixels.where(F.col("a") >= OPAQUE), grid).withColumns({"c": at("x", "cols"), "q": at("y", "rows")}).where("c < cols and q < rows")
    filled = ink.groupBy("asset_id", "cols", "rows").agg(F.countDistinct("c", "q").alias("frames"))
    need = F.greatest(F.lit(2), F.floor((F.col("cols") * F.col("rows") + 1) / 2))
    return filled.where(F.col("frames") >= need).select("asset_id", F.col("cols").cast("bigint").alias("cols"), F.col("rows").cast("bigint").alias("rows"), "frames", F.lit("spritesheet").alias("name"), F.when(F.col("frames") >= 4, 0.8).otherwise(0.6).alias("confidence"))


def sharpness(series: DataFrame, lags: tuple[int, int] = LAGS) -> DataFrame:
    """(series_id, lag, sharp): how far the autocorrelation at each lag stands above its neighbours.

    All lags come from one window over each series instead of a self-join for each; flat and short series have none.
    """
    low, high = lags
    by = Window.partitionBy("series_id")
    rows = series.withColumns({"n": F.count("*").over(by), "c": F.col("value").cast("double") - F.avg(F.col("value").cast("double")).over(by)})
    rows = rows.where(F.col("n") > high + 2)
    ahead = Window.partitionBy("series_id").orderBy("i")
    rows = rows.withColumns({f"l{k}": F.col("c") * F.lead("c", k).over(ahead) for k in range(low - 1, high + 2)})
    stats = rows.groupBy("series_id").agg(F.avg(F.col("c") * F.col("c")).alias("var"), *[F.avg(f"l{k}").alias(f"l{k}") for k in range(low - 1, high + 2)]).where("var > 1e-12")
    corr = lambda k: F.col(f"l{k}") / F.col("var")
    sharp = F.array(*[F.struct(F.lit(k).alias("lag"), (corr(k) - (corr(k - 1) + corr(k + 1)) / 2).alias("sharp")) for k in range(low, high + 1)])
    return stats.select("series_id", F.inline(sharp))


def period(series: DataFrame, lags: tuple[int, int] = LAGS, group: str = "series_id") -> DataFrame:
    """(group, period): the smallest lag nearly as sharp as the sharpest, null where none is; signals of a group are averaged."""
    keys = series.select("series_id", *([] if group == "series_id" else [group])).distinct()
    mean = sharpness(series, lags).join(keys, "series_id").groupBy(group, "lag").agg(F.avg("sharp").alias("sharp"))
    top = F.max("sharp").over(Window.partitionBy(group))  # a row for each lag
    found = mean.withColumn("top", top).where((F.col("sharp") >= F.col("top") * FUNDAMENTAL) & (F.col("top") >= PEAK)).groupBy(group).agg(F.min("lag").cast("bigint").alias("period"))
    return keys.select(group).distinct().join(found, group, "left")


def boundary_signals(pixels: DataFrame) -> DataFrame:
    """(series_id, asset_id, i, value): mean step of the grey level across each column boundary and each row boundary."""
    grey = F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    rows = pixels.select("asset_id", "y", "x", grey.alias("v"))
    out = None
    for axis, other, name in (("x", "y", ":x"), ("y", "x", ":y")):
        step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("asset_id", other).orderBy(axis)))
        one = rows.withColumn("s", step).where("s is not null").groupBy("asset_id", axis).agg(F.avg("s").alias("value")).select(F.concat(F.col("asset_id").cast("string"), F.lit(name)).alias("series_id"), "asset_id", (F.col(axis) - 1).cast("bigint").alias("i"), "value")
        out = one if out is None else out.union(one)
    return out


def upscale(pixels: DataFrame, blocks: DataFrame) -> DataFrame:
    """(asset_id, block_size, name, confidence) of pictures that a period (asset_id, period) shows to be scaled up."""
    size = pixels.groupBy("asset_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    fit = blocks.join(size, "asset_id").where(F.col("period") >= 2).where((F.floor(F.least("w", "h") / F.col("period")) >= LEAST_BLOCKS) & ((F.col("w") % F.col("period") == 0) | (F.col("h") % F.col("period") == 0)))
    at = lambda axis: F.floor(F.col(axis) / F.col("period"))
    inside = (at("x") < F.floor(F.col("w") / F.col("period"))) & (at("y") < F.floor(F.col("h") / F.col("period")))
    spread = _met(pixels, fit).where(inside).groupBy("asset_id", "period", at("y").alias("by"), at("x").alias("bx")).agg(sum((F.max(c) - F.min(c)).cast("double") for c in RGB).alias("s"))
    flat = spread.groupBy("asset_id", "period").agg((F.avg("s") / 3).alias("mean")).where(F.col("mean") <= FLAT_BLOCK)
    return flat.select("asset_id", F.col("period").cast("bigint").alias("block_size"), F.lit("pixel-art").alias("name"), F.lit(0.9).alias("confidence"))


def native_pixel_art(facts: DataFrame) -> DataFrame:
    """(asset_id, block_size, name, confidence) of pictures (width, height, color_count) small and plain enough."""
    hit = facts.where((F.greatest("width", "height") <= NATIVE_EDGE) & (F.col("color_count") <= NATIVE_COLOURS))
    return hit.select("asset_id", F.lit(1).cast("bigint").alias("block_size"), F.lit("pixel-art").alias("name"), F.lit(0.6).alias("confidence"))


def pixels_of(rasters: DataFrame) -> DataFrame:
    """The long table of rasters (asset_id, width, height, channels, data: rows of BGR or BGRA bytes)."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for asset, w, h, n, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                b, g, r = (px[:, :, min(k, n - 1)].ravel().astype(np.int32) for k in (0, 1, 2))
                a = px[:, :, 3].ravel().astype(np.int32) if n == 4 else np.full(w * h, 255, np.int32)
                y, x = (v.ravel().astype(np.int32) for v in np.mgrid[0:h, 0:w])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(w * h, asset, np.int64)), *map(pa.array, (y, x, r, g, b, a))], names=["asset_id", "y", "x", "r", "g", "b", "a"])

    return rasters.select("asset_id", "width", "height", "channels", "data").mapInArrow(work, "asset_id long, y int, x int, r int, g int, b int, a int")
