"""The precompute job reads its points once, and checks its tiles once."""

from pyspark.sql import functions as F

from tileloom import bindings as b
from tileloom.plans import split_precompute as sp

D = "/root/testdata/sf0.001"


def test_points_and_checks_are_read_once(spark):
    points = b.points(spark, D).localCheckpoint()
    checked = b.local_tiles(spark, D).withColumn("is_valid", F.col("tile_id") != "tile_4").withColumn(
        "reason_code", F.when(F.col("tile_id") == "tile_4", F.lit("few_uav"))).localCheckpoint()
    reads = {"points": spark.sparkContext.accumulator(0), "tiles": spark.sparkContext.accumulator(0)}

    def counted(df, seen):
        def each(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(each, df.schema)

    out = sp.split_and_precompute(
        counted(checked, reads["tiles"]), b.polygons(spark, D), 12.0, counted(points, reads["points"]), b.pixels(spark, D),
        ["intensity", "z"], "2024-01-15", max_sparse=80, max_dense=300, start_cm=20.0, k=4, cap_z=25.0,
    )
    kept = {(r.tile_id, r.cloud): r["count"] for r in out["points"].groupBy("tile_id", "cloud").count().collect()}
    tiles = {r.tile_id for r in points.select("tile_id").distinct().collect()} - {"tile_4"}
    assert {t for t, _ in kept} == tiles and all(kept[t, "uav"] <= 300 and kept[t, "dep"] <= 80 for t in tiles)
    assert "intensity_norm" in out["points"].columns and out["edges"].count() > 0 and out["events"].count() > 0
    assert {r.split for r in out["split"].where("tile_id = 'tile_4'").collect()} == {"invalid"}
    assert reads["points"].value == points.count() and reads["tiles"].value == checked.count()
