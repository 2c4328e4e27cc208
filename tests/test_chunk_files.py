"""Chunks of few rows are one file each."""

import glob

from pyspark.sql import functions as F

from tileloom.sources import tiles


def test_chunks_alike_are_one_file_each(spark, tmp_path):
    rows = spark.range(2000).select(F.format_string("t%03d", F.col("id") % 100).alias("tile_id"), F.col("id").alias("_n"))
    out = str(tmp_path / "chunks")
    # Small shares would share a task, and with it a file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tiles.write_chunks(rows, out, 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(f"{out}/chunk_ix=*/*.parquet")) == 15
    back = tiles.read_chunks(spark, out)
    assert sorted(map(tuple, back.select("tile_id", "_n").collect())) == sorted(map(tuple, rows.collect()))
    assert back.where("chunk_ix <> tile_number div 7").count() == 0
