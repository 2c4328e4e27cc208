"""Tiles of few points are searched and thinned where their points meet, which travel once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileloom.operators import voxel

SIZES = {"a": 220, "b": 90, "c": 140, "d": 12, "e'": 60}


def tiles(spark, reads=None, more=()):
    rng = np.random.default_rng(3)
    # Coordinates of two places: several points of a voxel are equally far from its centre.
    rows = [(t, i, *p) for t, n in SIZES.items() for i, p in enumerate((rng.random((n, 3)) * 6 - 2).round(2).tolist())]
    made = spark.createDataFrame(rows + rows[5:9] + rows[-5:] + list(more), "tile_id string, pid long, x double, y double, z double")
    made = made.withColumn("name", F.concat("tile_id", "pid"))
    if reads is None:
        return made

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return made.localCheckpoint().mapInArrow(seen, made.schema)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("ratio", [1.0, 0.5])
def test_flags_are_the_same_with_the_other_search(spark, monkeypatch, ratio):
    find = lambda: rows(voxel.downsample_to_caps(tiles(spark), [30, 80], 20.0, ratio))
    together = find()
    assert len(together) == sum(SIZES.values()) + 9
    for most in (100, 0):
        monkeypatch.setattr(voxel, "POINTS_SEARCHED", most)
        assert find() == together


@pytest.mark.parametrize("small", [True, False])
def test_points_are_the_same_with_the_other_search(spark, monkeypatch, small):
    find = lambda: rows(voxel.adaptive_downsample(tiles(spark), 30, 20.0, 0.5, keep_if_small=small))
    together = find()
    monkeypatch.setattr(voxel, "POINTS_SEARCHED", 100)
    assert find() == together


def test_caps_read_their_points_twice(spark):
    reads = spark.sparkContext.accumulator(0)
    points = tiles(spark, reads)
    flags = voxel.downsample_to_caps(points, [30, 80], 20.0)
    assert flags.where("keep_30").count() <= flags.where("keep_80").count()
    # Once to count the tiles' points, and once for each of the two counts here.
    assert reads.value <= 3 * (sum(SIZES.values()) + 9)
