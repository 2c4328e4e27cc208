"""Stored masks and graphs are used again only where settings and clouds are the same."""

from pyspark.sql import functions as F

from tileloom import bindings as b
from tileloom.operators import normalize, voxel
from tileloom.plans import split_precompute as sp

D = "/root/testdata/sf0.001"


def test_digests_know_the_cloud_and_not_its_order(spark):
    uav = b.points(spark, D).where("cloud = 'uav'")
    digests = lambda df: {r.tile_id: r.digest for r in voxel.cloud_digests(df).collect()}
    own = digests(uav)
    assert own == digests(uav.repartition(7).orderBy("z"))
    moved = digests(uav.withColumn("z", F.when(F.col("tile_id") == "tile_3", F.col("z") + 1e-9).otherwise(F.col("z"))))
    assert {t for t in own if own[t] != moved[t]} == {"tile_3"}


def test_precompute_uses_valid_masks_and_graphs_again(spark):
    points, pixels, tiles = b.points(spark, D), b.pixels(spark, D), b.local_tiles(spark, D)
    stats = normalize.attribute_statistics(points, ["intensity"])
    radar = normalize.band_statistics(pixels.where("sensor = 'uavsar'"), "uavsar")
    run = lambda p, **old: sp.precompute(tiles, p, pixels, ["intensity"], "2024-01-15", stats, radar, max_sparse=80, max_dense=300, start_cm=20.0, k=4, cap_z=25.0, **old)
    first = run(points)
    # Graphs with a mark: they are used again in tiles as they were, and made anew in tile 1.
    marked = first["graphs"].where("src < dst")
    again = run(points.where("tile_id <> 'tile_1' or pid % 5 <> 0"), masks=first["masks"], graphs=marked)["edges"]
    assert again.where("src >= dst and tile_id <> 'tile_1'").count() == 0
    assert again.where("tile_id <> 'tile_1'").count() == marked.where("tile_id <> 'tile_1'").count()
    assert again.where("src > dst and tile_id = 'tile_1'").count() == again.where("src < dst and tile_id = 'tile_1'").count() > 0
