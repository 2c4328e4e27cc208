"""Points, stored masks and digests of many tiles share a call; points travel once."""

from pyspark.sql import functions as F
from test_thinned_tiles import SIZES, rows, tiles

from tileloom.operators import voxel
from tileloom.plans.split_precompute import MASKS


def test_masks_are_the_same_with_the_other_search(spark, monkeypatch):
    """Masks of three kinds: valid with rows struck out, of another cloud, and of another cap."""
    none = spark.createDataFrame([], MASKS)
    mask = lambda t, p, cap: voxel.downsample_with_masks(p.where(F.col("tile_id") == t), none, cap, 20.0, 0.5)[1]
    stored = mask("a", tiles(spark), 30).where("pid % 2 = 0")
    stored = stored.unionByName(mask("b", tiles(spark).where("z < 2"), 30)).unionByName(mask("c", tiles(spark), 40))
    stored = stored.localCheckpoint()
    # A point of no tile is dropped.
    points = tiles(spark, more=[(None, 1, 0.0, 0.0, 0.0)])
    find = lambda: [rows(df) for df in voxel.downsample_with_masks(points, stored, 30, 20.0, 0.5)]
    together = find()
    monkeypatch.setattr(voxel, "POINTS_SEARCHED", 100)
    assert find() == together
    kept = {r.tile_id: r.pids for r in voxel.downsample_with_masks(points, stored, 30, 20.0, 0.5)[0].groupBy("tile_id").agg(F.sort_array(F.collect_set("pid")).alias("pids")).collect()}
    anew = {r.tile_id: r.pids for r in voxel.adaptive_downsample(points, 30, 20.0, 0.5).groupBy("tile_id").agg(F.sort_array(F.collect_set("pid")).alias("pids")).collect()}
    assert set(kept) == set(SIZES) and kept["a"] == [p for p in anew["a"] if p % 2 == 0]
    assert {t: p for t, p in kept.items() if t != "a"} == {t: p for t, p in anew.items() if t != "a"}


def test_masks_read_their_points_twice(spark):
    reads = spark.sparkContext.accumulator(0)
    kept, masks = voxel.downsample_with_masks(tiles(spark, reads), spark.createDataFrame([], MASKS), 30, 20.0, 0.5)
    assert kept.count() == masks.count() > 0
    assert reads.value <= 2 * (sum(SIZES.values()) + 9)
