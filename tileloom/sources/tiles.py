"""Tiles and tile tables: reading, sampling, chunked writing and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tileloom import schemas
from tileloom.functions.draws import uniform
from tileloom.operators.ranks import numbered, numbered_within, spare, totals

#: A chunk is split among several tasks if it has more rows than this, or more than twice the mean chunk's.
ROWS_PER_SHARE = 500_000


def tiles_from_features(raw: DataFrame, source: str = "geojson") -> DataFrame:
    """One row per feature with its box, its id and its position in the file."""
    each = raw.select(F.posexplode("features").alias("ix", "f"))
    corner = F.flatten(F.col("f.geometry.coordinates"))
    xs, ys = F.transform(corner, lambda p: p[0]), F.transform(corner, lambda p: p[1])
    given = F.coalesce(F.col("f.properties")["tile_id"], F.col("f.id"), F.col("ix").cast("string"))
    return each.select(
        given.alias("tile_id"),
        F.concat(F.lit("tile_"), F.col("ix").cast("string")).alias("position_id"),
        F.lit(source).alias("source"),
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return tiles_from_features(spark.read.schema(schemas.TILE_FILE).option("multiLine", True).json(path))


def attach_geometry(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """S3: boxes by positional id, unmatched rows stay."""
    shapes = tiles.select(
        F.col("position_id").alias("tile_id"), "xmin", "ymin", "xmax", "ymax"
    )
    return rows.join(shapes, "tile_id", "left")


def sample_tiles(tiles: DataFrame, n: int, seed) -> DataFrame:
    """N tiles in hash order; a top-k, never a full sort."""
    return tiles.withColumn("_u", uniform(seed, F.col("tile_id"))).orderBy("_u", "tile_id").limit(n).drop("_u")


def read_chunks(
    spark: SparkSession, path: str, max_files: int | None = None, max_tiles: int | None = None,
    as_float: bool = False,
) -> DataFrame:
    """All chunk files as one table with the file each row came from."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("source_file"))
    return combine_chunks(rows, max_files, max_tiles, as_float)


def combine_chunks(
    rows: DataFrame, max_files: int | None = None, max_tiles: int | None = None, as_float: bool = False
) -> DataFrame:
    """S4's caps: the first files by name, the first tiles of each file by id."""
    if max_files is not None:
        files = rows.select("source_file").distinct().orderBy("source_file").limit(max_files)
        rows = rows.join(files, "source_file", "left_semi")
    if max_tiles is not None:
        tiles = rows.select("source_file", "tile_id").distinct()
        first = numbered_within(tiles, ["source_file"], ["tile_id"]).where(F.col("number") < max_tiles)
        rows = rows.join(first.drop("number"), ["source_file", "tile_id"], "left_semi")
    if as_float:
        rows = rows.select(*[
            F.col(n).cast("float").alias(n) if t == "double" else F.col(n) for n, t in rows.dtypes
        ])
    return rows


def with_chunks(tiles: DataFrame, size: int) -> DataFrame:
    """Number and chunk of each tile: exactly ``size`` tiles per chunk in id order, the rest in the last."""
    placed = numbered(tiles, ["tile_id"], "tile_number")
    return placed.withColumn("chunk_ix", F.floor(F.col("tile_number") / F.lit(size)).cast("int"))


def write_chunks(rows: DataFrame, path: str, size: int, mode: str = "append", salts: int = 8) -> None:
    """The rows of ``size`` tiles in each chunk folder, with the tile's number.

    A chunk of many rows, or of far more than the others, is written by up to ``salts`` tasks, each with a share
    of every tile's rows, so that a tile of very many rows is not one task's; files are of bounded length. Other
    chunks are one file each.
    """
    share, parts, n = spare(rows, "_share", "_parts", "_n")
    sizes = rows.groupBy("tile_id").agg(F.count(F.lit(1)).alias(n))
    chunks = with_chunks(sizes, size)
    every = totals(chunks, rows=F.sum(n), chunks=F.max("chunk_ix") + 1)
    usual = F.least(F.lit(ROWS_PER_SHARE), F.lit(2) * every["rows"] / every["chunks"])
    needed = F.ceil(F.sum(n).over(Window.partitionBy("chunk_ix")) / usual)
    chunks = chunks.withColumn(parts, F.least(needed, F.lit(salts))).drop(n)
    dealt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col(parts))
    rows.join(chunks, "tile_id").withColumn(share, dealt).drop(parts).repartition("chunk_ix", share).sortWithinPartitions(
        "chunk_ix", "tile_number"
    ).drop(share).write.mode(mode).option("maxRecordsPerFile", 2_000_000).partitionBy("chunk_ix").parquet(path)


def write_splits(rows: DataFrame, stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per split, the statistics beside them."""
    rows.write.mode(mode).option("maxRecordsPerFile", 2_000_000).partitionBy("split").parquet(f"{path}/tiles")
    stats.write.mode(mode).parquet(f"{path}/stats")


def dataset_summary(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Points per cloud, images per sensor and what is there, one row per tile."""
    clouds = points.groupBy("tile_id").agg(
        F.count(F.when(F.col("cloud") == "dep", 1)).alias("n_dep"),
        F.count(F.when(F.col("cloud") == "uav", 1)).alias("n_uav"),
    )
    images = pixels.select("tile_id", "sensor", "image_id").distinct().groupBy("tile_id").agg(
        F.count(F.when(F.col("sensor") == "naip", 1)).alias("n_naip"),
        F.count(F.when(F.col("sensor") == "uavsar", 1)).alias("n_uavsar"),
    )
    zero = F.lit(0).cast("bigint")
    joined = clouds.join(images, "tile_id", "left")
    return joined.select(
        "tile_id", "n_dep", "n_uav",
        F.coalesce("n_naip", zero).alias("n_naip"), F.coalesce("n_uavsar", zero).alias("n_uavsar"),
        (F.coalesce("n_naip", zero) > 0).alias("has_naip"),
        (F.coalesce("n_uavsar", zero) > 0).alias("has_uavsar"),
    )


def ledger(tiles: DataFrame, reasons: DataFrame) -> DataFrame:
    """One row per tile with its outcome; ``reasons`` lists the failed ones."""
    joined = tiles.select("tile_id").join(reasons.select("tile_id", "reason"), "tile_id", "left")
    status = F.when(F.col("reason").isNull(), F.lit("succeeded")).otherwise(F.lit("failed"))
    return joined.withColumn("status", status)


def to_rerun(tiles: DataFrame, log: DataFrame) -> DataFrame:
    """Tiles that no run has finished."""
    done = log.where(F.col("status") == "succeeded").select("tile_id")
    return tiles.join(done, "tile_id", "left_anti")


def run_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n_tiles"))


def size_in_bytes(packed: DataFrame, array: str, width: int = 4) -> DataFrame:
    """Bytes of an array column, per group of rows with the same source file."""
    bytes_ = F.sum(F.size(array).cast("bigint") * F.lit(width))
    return packed.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), bytes_.alias("n_bytes"))


def one_tile(rows: DataFrame, tile_id: str) -> DataFrame:
    """The filter reaches the scan."""
    return rows.where(F.col("tile_id") == tile_id)


def tile_ids(rows: DataFrame) -> DataFrame:
    return rows.select("tile_id").distinct()


def tile_at(rows: DataFrame, position: int) -> DataFrame:
    """The rows of the tile at a position (from 0) in id order."""
    wanted = numbered(tile_ids(rows), ["tile_id"]).where(F.col("number") == position)
    return rows.join(wanted, "tile_id", "left_semi")


def pack_images(pixels: DataFrame, key: list[str]) -> DataFrame:
    """Pixels to one array per image and band, in row-major order. An image is bounded."""
    cells = F.array_sort(F.collect_list(F.struct("row", "col", F.col("v").cast("float").alias("v"))))
    packed = pixels.groupBy(*key).agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), cells.alias("_c")
    )
    return packed.withColumn("data", F.transform("_c", lambda c: c["v"])).drop("_c")
