"""Files in and out, and the incremental ingest."""

import json

from pyspark.sql import functions as F

from tileloom.operators import spatial
from tileloom.sources import catalog, tiles
from tileloom.streaming.ingest import ingest_new_items


def feature(i, deep=False):
    box = [0, 0, 1, 5, 6, 9] if deep else [0, 0, 5, 6]
    return {"id": f"item{i}", "collection": "c", "bbox": box, "properties": {"datetime": "2024-01-02T03:04:05"},
            "assets": {"data": {"href": f"f{i}.laz"}}}


def test_items(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(feature(i, i == 1)))
    got = {r["item_id"]: r for r in catalog.read_items(spark, str(tmp_path)).collect()}
    assert got["item0"]["maxx"] == 5 and got["item0"]["minz"] is None
    assert (got["item1"]["maxx"], got["item1"]["minz"], got["item1"]["maxz"]) == (5, 1, 9)


def test_ingest_adds_each_item_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "cat"), str(tmp_path / "state")
    source.mkdir()
    (source / "0.json").write_text(json.dumps(feature(0)))
    ingest_new_items(spark, str(source), out, state).awaitTermination(120)
    (source / "again.json").write_text(json.dumps(feature(0)))
    (source / "1.json").write_text(json.dumps(feature(1)))
    ingest_new_items(spark, str(source), out, state).awaitTermination(120)
    assert sorted(r["item_id"] for r in spark.read.parquet(out).collect()) == ["item0", "item1"]


def test_tiles_and_chunks(spark, tmp_path):
    ring = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    doc = {"features": [{"id": None, "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    path = tmp_path / "t.geojson"
    path.write_text(json.dumps(doc))
    row = tiles.read_tiles(spark, str(path)).first()
    assert (row["tile_id"], row["position_id"], row["xmax"]) == ("0", "tile_0", 10.0)
    rows = spark.range(100).select(F.concat(F.lit("t"), (F.col("id") % 20).cast("string")).alias("tile_id"), F.col("id").cast("double").alias("v"))
    out = str(tmp_path / "chunks")
    tiles.write_chunks(rows, out, 5)
    back = tiles.read_chunks(spark, out, as_float=True)
    assert back.count() == 100 and dict(back.dtypes)["v"] == "float"
    assert back.groupBy("tile_id").agg(F.count_distinct("chunk_ix").alias("n")).where("n > 1").count() == 0
    tiles.write_splits(rows.withColumn("split", F.lit("train")), rows.limit(1), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "tiles")).count() == 100


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spatial_joins_have_keys(spark):
    from tileloom import bindings as b

    d = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            catalog.items_on_tiles(b.items(spark, d), b.tiles(spark, d), 20.0, "1996-01-01", "1997-01-01"),
            spatial.points_to_tiles(b.world_points(spark, d), b.tiles(spark, d), 11.5),
            spatial.tiles_on_polygons(b.tiles(spark, d), b.polygons(spark, d), 12.0),
            spatial.tiles_on_polygons(b.tiles(spark, d), b.polygons(spark, d), 12.0, "contained"),
        ):
            text = plan(df)
            assert "CartesianProduct" not in text and "NestedLoop" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_pushdown(spark):
    from tileloom import bindings as b
    from tileloom.sources.catalog import in_dates

    text = plan(b.items(spark, "/root/testdata/sf0.001").where(in_dates(F.col("dt"), "1996-01-01", "1997-01-01")).select("item_id"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp>" in text.replace("_ntz", "")


def test_partition_count_does_not_matter(spark):
    from contract import load

    queries, _ = load()
    d = "/root/testdata/sf0.001"
    seen = []
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append({name: sorted(map(str, queries[name](spark, d).collect())) for name in ("tile_validity", "capped_cloud", "voxel_downsample")})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] == seen[2]
