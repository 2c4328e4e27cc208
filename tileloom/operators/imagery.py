"""Dated images: acquisition events, slots, change, stretching and regridding."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tileloom.functions.values import is_finite
from tileloom.operators.grid import BLOCK
from tileloom.operators.ranks import named_percentiles, spare


def acquisition_events(images: DataFrame, key: list[str], gap_days: int = 1) -> DataFrame:
    """Images by date; a gap of more than ``gap_days`` starts a new event.

    ``images`` has one row per image. The events are found on the distinct dates of
    a key, so however many images a key has, its window holds at most one row per day.
    """
    days = images.select(*key, "dt").distinct()
    w = Window.partitionBy(*key).orderBy("dt")
    starts = F.coalesce((F.date_diff("dt", F.lag("dt").over(w)) > gap_days).cast("int"), F.lit(0))
    numbered = days.withColumn("_s", starts).withColumn("event_ix", F.sum("_s").over(w)).drop("_s")
    return images.join(numbered, [*key, "dt"])


def event_slots(
    events: DataFrame, key: list[str], least: int = 2, most: int = 8, order: tuple = ("dt", "image_id")
) -> DataFrame:
    """Events with enough images, the first ``most`` of each in slots 0, 1, ...

    The rank filter lets Spark cut each event before the shuffle.
    """
    event = [*key, "event_ix"]
    kept = events.groupBy(*event).agg(
        F.count(F.lit(1)).alias("n_images"), F.min("dt").alias("event_dt")
    ).where(F.col("n_images") >= least)
    w = Window.partitionBy(*event).orderBy(*order)
    slots = events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return slots.join(kept, event).withColumn("slot", F.col("_rn") - 1).drop("_rn")


def attention_masks(slots: DataFrame, key: list[str], most: int = 8) -> DataFrame:
    """Per event which of the slots are filled."""
    filled = slots.groupBy(*key, "event_ix", "event_dt").agg(F.collect_set("slot").alias("_s"))
    every = F.sequence(F.lit(0), F.lit(most - 1))
    mask = F.transform(every, lambda i: F.array_contains("_s", i))
    return filled.select(*key, "event_ix", "event_dt", mask.alias("attention_mask"))


def change_between_images(pixels: DataFrame, key: list[str]) -> DataFrame:
    """Difference to the previous image and the day gap over the largest gap of the tile."""
    w = Window.partitionBy(*key).orderBy("dt", "image_id")
    steps = pixels.withColumn("dv", F.col("v") - F.lag("v").over(w)).withColumn(
        "gap", F.date_diff("dt", F.lag("dt").over(w))
    )
    longest = steps.groupBy("tile_id").agg(F.max(F.abs("gap")).alias("_most"))
    scaled = F.col("gap") / (F.col("_most") + F.lit(1e-6))
    joined = steps.where(F.col("gap").isNotNull()).join(longest, "tile_id")
    return joined.withColumn("gap_scaled", scaled).drop("_most", "gap")


def stretch(pixels: DataFrame, key: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The low and high percentile of the positive finite pixels of an image to 0 and 255.

    Pixels that aren't finite get level 0.
    """
    finite = is_finite(F.col("v"))
    positive = pixels.where((F.col("v") > 0) & finite)
    ends = named_percentiles(positive, key, "v", {"_lo": low, "_hi": high})
    share = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    level = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(255.0)
    joined = pixels.join(ends, key, "left")
    return joined.withColumn("level", F.when(finite, F.coalesce(level, F.lit(0.0))).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def _kernel(method: str) -> tuple[list[int], object]:
    if method == "nearest":
        return [0], lambda t: F.lit(1.0)
    if method == "bilinear":
        return [0, 1], lambda t: F.greatest(F.lit(1.0) - F.abs(t), F.lit(0.0))
    if method == "cubic":
        a = -0.5

        def weight(t):
            s = F.abs(t)
            near = (a + 2) * s * s * s - (a + 3) * s * s + 1
            far = a * s * s * s - 5 * a * s * s + 8 * a * s - 4 * a
            return F.when(s <= 1, near).when(s < 2, far).otherwise(F.lit(0.0))

        return [-1, 0, 1, 2], weight
    raise ValueError("method must be nearest, bilinear or cubic")


def regrid(
    pixels: DataFrame,
    key: list[str],
    source: tuple[float, float, float],
    target: tuple[float, float, float, float],
    res: float,
    method: str = "bilinear",
    fill: float = 0.0,
) -> DataFrame:
    """Images on another grid of the same coordinate system, origin top left.

    ``source`` is (xmin, ymax, resolution), ``target`` the box; its size is rounded
    up. Each source pixel adds to the few target pixels whose kernel it lies under: blocks of
    pixels are dealt to tasks, so that a task sums what its pixels add before anything is shuffled.
    Missing pixels are left out of the weights, and a target without any source is ``fill``.
    """
    x0, y1, sres = source
    txmin, tymin, txmax, tymax = target
    ncols, nrows = math.ceil((txmax - txmin) / res), math.ceil((tymax - tymin) / res)
    offsets, weight = _kernel(method)
    r, c, fr, fc, wv, ws = spare(pixels.select(*key, "row", "col"), "_r", "_c", "_fr", "_fc", "_wv", "_ws")
    # centre of the target pixel in source pixel units, centres of source pixels at whole numbers
    fx = (F.lit(txmin) + (F.col(c) + 0.5) * res - F.lit(x0)) / sres - 0.5
    fy = (F.lit(y1) - (F.lit(tymax) - (F.col(r) + 0.5) * res)) / sres - 0.5
    start = lambda f: F.floor(F.col(f) + F.lit(0.5 if method == "nearest" else 0.0)).cast("int")

    def reached(rows, at, out, f, centre, first, n):
        """Rows per target index whose kernel holds the source index; ``first`` is the centre of target 0."""
        ends = [
            F.floor((F.col(at) + F.lit(float(o)) - F.lit(first)) * F.lit(sres / res)).cast("int") + more
            for o, more in ((-offsets[-1] - 1, -1), (-offsets[0] + 1, 2))
        ]
        low, high = F.greatest(ends[0], F.lit(0)), F.least(ends[1], F.lit(n - 1))
        some = rows.where(low <= high).withColumn(out, F.explode(F.sequence(low, high))).withColumn(f, centre)
        return some.where((F.col(at) - start(f)).between(offsets[0], offsets[-1]))

    known = reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in key])
    block = [F.floor(F.col(i) / F.lit(BLOCK)) for i in ("row", "col")]
    met = pixels.where(known & F.col("v").isNotNull()).select(*key, "row", "col", "v").repartition(*key, *block)
    met = reached(met, "row", r, fr, fy, (y1 - tymax + 0.5 * res) / sres - 0.5, nrows)
    met = reached(met, "col", c, fc, fx, (txmin - x0 + 0.5 * res) / sres - 0.5, ncols)
    w = weight(F.col(fr) - F.col("row")) * weight(F.col(fc) - F.col("col"))
    added = met.withColumn(ws, w).where(F.col(ws) != 0).select(
        *key, F.col(r).alias("row"), F.col(c).alias("col"), (F.col(ws) * F.col("v")).alias(wv), ws
    )
    # Every target of every image once, with nothing added: those without a source get ``fill``.
    grid = pixels.select(*key).distinct().select(*key, F.explode(F.sequence(F.lit(0), F.lit(nrows - 1))).alias("row"))
    grid = grid.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))))
    nothing = [F.lit(None).cast("double").alias(n) for n in (wv, ws)]
    found = added.unionByName(grid.select("*", *nothing)).groupBy(*key, "row", "col").agg(
        F.sum(wv).alias(wv), F.sum(ws).alias(ws)
    )
    value = F.coalesce(F.try_divide(wv, ws), F.lit(float(fill)))
    return found.select(*key, "row", "col", value.alias("v"))
