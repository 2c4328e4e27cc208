"""Caps never lose rows of groups below them; equal rows survive filters."""

import pytest
from pyspark.sql import functions as F

from tileloom.operators import augment, quality, ranks, report, spatial
from tileloom.plans import split_precompute


def cloud(spark, sizes):
    rows = [(t, "uav", float(i), float(i % 7), float(i % 5), i) for t, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "tile_id string, cloud string, x double, y double, z double, pid long")


@pytest.mark.parametrize("n", [0, 3, 5, 6, 40])
def test_lowest_n_below_at_and_above_the_group(spark, n):
    sizes = {"a": 3, "b": 5, "c": 40}
    draw = F.pmod(F.xxhash64("tile_id", "pid"), F.lit(1_000_003)) / 1_000_003.0
    kept = ranks.lowest_n(cloud(spark, sizes), ["tile_id"], draw, n, ["pid"])
    got = {r["tile_id"]: r["count"] for r in kept.groupBy("tile_id").count().collect()}
    assert got == {t: min(n, k) for t, k in sizes.items() if min(n, k)}


def test_cap_keeps_small_clouds(spark):
    kept = quality.cap_points(cloud(spark, {"a": 50, "b": 100}), "uav", 80, "42")
    assert {r["tile_id"]: r["count"] for r in kept.groupBy("tile_id").count().collect()} == {"a": 50, "b": 80}


def test_augmented_tiles_below_the_floor_stay(spark):
    points = cloud(spark, {"a": 50})
    assert augment.mask_points(points, "1", 1.0, 5.0).count() == 50
    assert augment.remove_slice(points, "1", 1.0, 2.0, 0.9).count() == 50


def test_any_box_keeps_equal_rows(spark):
    box = ("x0", "y0", "x1", "y1")
    items = spark.createDataFrame([("i", 0.0, 0.0, 1.0, 1.0)] * 2 + [("j", 9.0, 9.0, 9.5, 9.5)], "item string, x0 double, y0 double, x1 double, y1 double")
    areas = spark.createDataFrame([(0.5, 0.5, 2.0, 2.0), (0.2, 0.2, 3.0, 3.0)], "xmin double, ymin double, xmax double, ymax double")
    assert [r["item"] for r in spatial.any_box(items, areas, 0.7, box, spatial.BOX).collect()] == ["i", "i"]


def test_more_than_a_thousand_metrics(spark):
    names = [f"m{k:04d}" for k in range(1100)]
    metrics = spark.createDataFrame([("t", "a", k, 1.0) for k in names], "tile_id string, model string, metric string, v double")
    wide = report.samples_by_model(metrics, ["a"], names)
    assert "a_m1099" in wide.columns


@pytest.mark.parametrize("ratio, n", [(0.0, 0), (0.35, 35), (1.0, 100)])
@pytest.mark.parametrize("column", ["source", "_all", "_n", "_c"])
def test_random_part_is_exact(spark, ratio, n, column):
    tiles = spark.range(100).selectExpr("concat('t', id) as tile_id", f"'x' as {column}")
    part = split_precompute.random_part(tiles, ratio, "5")
    assert part.columns == ["tile_id", column] and part.count() == n
    assert part.select("tile_id").distinct().count() == n


@pytest.mark.parametrize("column", ["_u", "_b", "_c", "_n", "_all", "_want", "_before", "_last", "_left", "_rn", "_R", "_r"])
def test_lowest_n_leaves_columns_named_like_its_helpers(spark, column):
    points = spark.range(60).selectExpr(f"id % 3 as {column}", "id")
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    kept = ranks.lowest_n(points, [column], draw, 7, ["id"])
    assert {(r[0], r["count"]) for r in kept.groupBy(column).count().collect()} == {(0, 7), (1, 7), (2, 7)}
    other = ranks.lowest_n(points.withColumn("g", F.lit(1)), ["g"], draw, 7, ["id"])
    assert other.count() == 7 and other.columns == [column, "id", "g"]


def test_percentiles_refuse_columns_named_like_their_helpers(spark):
    with pytest.raises(ValueError):
        ranks.percentiles(spark.createDataFrame([(1, 2.0)], "c int, v double"), ["c"], "v", [0.5])
