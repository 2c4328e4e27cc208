"""Voxel sizes of small tiles, searched where their points meet, against the set-wise search."""

import numpy as np

from tileloom.operators import voxel


def tiles(spark, sizes):
    rng = np.random.default_rng(3)
    rows = [(t, i, *p) for t, n in sizes.items() for i, p in enumerate((rng.random((n, 3)) * 6 - 2).round(2).tolist())]
    return spark.createDataFrame(rows, "tile_id string, pid long, x double, y double, z double")


def found(points, *args, **options):
    return {r["tile_id"]: (r["size_cm"], r["n_points"], r["whole"]) for r in voxel.adaptive_sizes(points, *args, **options).collect()}


def test_both_searches_agree(spark, monkeypatch):
    points = tiles(spark, {"a": 200, "b": 90, "d": 12})
    together = found(points, 30, 20.0, 0.5)
    monkeypatch.setattr(voxel, "POINTS_SEARCHED", 100)
    assert found(points, 30, 20.0, 0.5) == together and together["d"] == (20.0, 12, True) and set(together) == set("abd")


def test_small_tiles_are_searched_in_few_jobs(spark):
    points = tiles(spark, {"a": 200, "b": 90})
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("search"))
    spark.sparkContext.setJobGroup("search", "sizes")
    found(points, 30, 4.0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs() <= 12
