"""Structure metrics per cell from heights above ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tileloom.operators.grid import CELL, cell_aggregate, floor_index
from tileloom.operators.ranks import named_percentiles

VEGETATION = 0.1


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def density_metrics(
    cells: DataFrame, height: str = "hag", canopy: float = 5.0, under: float = 1.0
) -> DataFrame:
    """G12-G16 in one pass over points that already carry row and col.

    Vegetation is everything above 0.1; a cell without any gives 0.
    """
    h = F.col(height)
    vegetation = _count(h > VEGETATION)
    return cells.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("point_density"),
        _ratio(_count(h > canopy), vegetation).alias("canopy_density"),
        _ratio(_count((h >= under) & (h < canopy)), vegetation).alias("mid_density"),
        _ratio(_count((h > VEGETATION) & (h <= under)), vegetation).alias("under_density"),
        _ratio(_count(h > canopy), F.count(F.lit(1))).alias("canopy_cover"),
    )


def layer_proportions(
    cells: DataFrame, low: float, high: float, n: int, height: str = "hag"
) -> DataFrame:
    """Share of each equal-width height layer; values outside the range are left out."""
    layer = F.floor((F.col(height) - F.lit(float(low))) / F.lit((high - low) / n)).cast("int")
    kept = cells.withColumn("layer", layer).where((F.col("layer") >= 0) & (F.col("layer") < n))
    per_layer = kept.groupBy(*CELL, "layer").agg(F.count(F.lit(1)).alias("_n"))
    total = per_layer.groupBy(*CELL).agg(F.sum("_n").alias("_t"))
    share = F.col("_n").cast("double") / F.col("_t")
    return per_layer.join(total, CELL).select(*CELL, "layer", share.alias("p"))


def layer_diversity(proportions: DataFrame) -> DataFrame:
    """Shannon diversity over the layers of a cell."""
    return proportions.groupBy(*CELL).agg((-F.sum(F.col("p") * F.log("p"))).alias("fhd"))


def height_statistics(
    cells: DataFrame, height: str = "hag", ps: tuple = (10, 25, 50, 75, 90)
) -> DataFrame:
    """Percentiles and max/mean/min/std per cell."""
    h = F.col(height)
    plain = cells.groupBy(*CELL).agg(
        F.max(h).alias("h_max"), F.avg(h).alias("h_mean"),
        F.min(h).alias("h_min"), F.stddev_pop(h).alias("h_std"),
    )
    ranked = named_percentiles(cells, CELL, height, {f"p{p}": p / 100.0 for p in ps})
    return plain.join(ranked, CELL)


def mean_cell_height(
    points: DataFrame, group: list[str], low: float = -5.0, high: float = 5.0,
    cell: float = 2.0, cap: float = 50.0, p: float = 0.95,
) -> DataFrame:
    """Mean over cells of the 95th height percentile, points above the cap left out."""
    n = int(-(-(high - low) // cell))
    row, col = floor_index(F.col("y"), F.lit(low), cell), floor_index(F.col("x"), F.lit(low), cell)
    kept = points.where(F.col("z") <= cap).withColumn("row", row).withColumn("col", col)
    kept = kept.where(F.col("row").between(0, n - 1) & F.col("col").between(0, n - 1))
    per_cell = named_percentiles(kept, [*group, "row", "col"], "z", {"q": p})
    return per_cell.groupBy(*group).agg(F.avg("q").alias("mean_pct95_z"))


def canopy_height_change(points: DataFrame, before: str, after: str, **options) -> DataFrame:
    """The metric of two clouds and their difference, one row per tile."""
    clouds = points.where(F.col("cloud").isin(before, after))
    found = mean_cell_height(clouds, ["tile_id", "cloud"], **options)
    wide = found.groupBy("tile_id").agg(
        F.max(F.when(F.col("cloud") == before, F.col("mean_pct95_z"))).alias("input_mean_pct95_z"),
        F.max(F.when(F.col("cloud") == after, F.col("mean_pct95_z"))).alias("gt_mean_pct95_z"),
    )
    change = F.col("gt_mean_pct95_z") - F.col("input_mean_pct95_z")
    return wide.withColumn("net_canopy_height_change", change)


def height_above_ground(points: DataFrame, box, res: float, nrows: int, ncols: int) -> DataFrame:
    """Height above the lowest return of the point's cell."""
    from tileloom.operators.grid import back_to_points

    ground = cell_aggregate(points, box, res, F.min, "z")
    joined = back_to_points(points, ground, box, res, nrows, ncols, "_ground")
    return joined.withColumn("hag", F.col("z") - F.col("_ground")).drop("_ground")
