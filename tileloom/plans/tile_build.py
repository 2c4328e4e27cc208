"""Tile assembly: items and points to tiles, gates, downsampling and joined outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tileloom.operators import quality
from tileloom.operators.spatial import points_to_tiles
from tileloom.operators.voxel import adaptive_downsample
from tileloom.session import cut_lineage
from tileloom.sources.tiles import ledger


def assemble(tiles: DataFrame, points: DataFrame, images: DataFrame) -> DataFrame:
    """Counts per cloud and sensor on every tile, with has_<sensor> flags."""
    clouds = quality.counts_by_cloud(points)
    sensors = images.select("tile_id", "sensor", "image_id").distinct().groupBy("tile_id").agg(
        F.count(F.when(F.col("sensor") == "naip", 1)).alias("n_naip"),
        F.count(F.when(F.col("sensor") == "uavsar", 1)).alias("n_uavsar"),
    )
    joined = tiles.join(clouds, "tile_id", "left").join(sensors, "tile_id", "left")
    return joined.withColumn("has_naip", F.coalesce(F.col("n_naip") > 0, F.lit(False))).withColumn(
        "has_uavsar", F.coalesce(F.col("n_uavsar") > 0, F.lit(False))
    )


def build_tiles(
    tiles: DataFrame, dense: DataFrame, sparse: DataFrame, width: float, min_dense: int, cap: int,
    start_cm: float = 4.0, ratio: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Points per tile and the ledger.

    The dense cloud is joined and counted first; the sparse cloud is only joined to
    tiles that passed. A tile without sparse points fails with that reason.
    """
    uav = points_to_tiles(dense, tiles, width).withColumn("cloud", F.lit("uav"))
    passed = quality.enough_points(tiles, uav, "uav", min_dense)
    kept = uav.join(passed.select("tile_id"), "tile_id", "left_semi")
    dep = points_to_tiles(sparse, passed, width).withColumn("cloud", F.lit("dep"))
    columns = ["tile_id", "cloud", "pid", "x", "y", "z"]
    # The size search reads these points several times: the join is done once.
    thinned = adaptive_downsample(cut_lineage(kept.select(*columns)), cap, start_cm, ratio)
    points = quality.common_union(dep.select(*columns), thinned)
    few = tiles.join(passed, "tile_id", "left_anti").select("tile_id", F.lit("too few UAV points").alias("reason"))
    none = passed.join(dep.select("tile_id").distinct(), "tile_id", "left_anti").select(
        "tile_id", F.lit("no DEP points").alias("reason")
    )
    return points, ledger(tiles, few.unionByName(none))
