"""Catalog items: reading, building from file listings, extents and matching to tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tileloom import schemas
from tileloom.functions import names
from tileloom.functions.values import parse_date
from tileloom.operators.spatial import join_boxes


def items_from_features(raw: DataFrame) -> DataFrame:
    """Feature rows to item rows; a 6-number box keeps its z range."""
    box = F.col("bbox")
    flat = F.size(box) == 4
    return raw.select(
        F.col("id").alias("item_id"),
        "collection",
        parse_date(F.coalesce(F.col("properties")["datetime"], F.col("properties")["start_datetime"])).alias("dt"),
        box[0].alias("minx"),
        box[1].alias("miny"),
        F.when(flat, F.try_element_at(box, F.lit(3))).otherwise(F.try_element_at(box, F.lit(4))).alias("maxx"),
        F.when(flat, F.try_element_at(box, F.lit(4))).otherwise(F.try_element_at(box, F.lit(5))).alias("maxy"),
        F.when(~flat, F.try_element_at(box, F.lit(3))).alias("minz"),
        F.when(~flat, F.try_element_at(box, F.lit(6))).alias("maxz"),
        F.transform_values("assets", lambda _, a: a["href"]).alias("assets"),
        F.col("properties").alias("props"),
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Item files (one JSON document each) under a folder."""
    raw = spark.read.schema(schemas.ITEM_FILE).option("multiLine", True)
    return items_from_features(raw.option("recursiveFileLookup", True).json(path))


def in_dates(dt: Column, start: str, end: str) -> Column:
    """date part only, both ends included."""
    return F.to_date(dt).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def items_on_tiles(
    items: DataFrame, tiles: DataFrame, width: float, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Items whose box touches a tile, within the dates.

    The date filter is on the scan side of the join, so it reaches the reader.
    """
    if start is not None:
        items = items.where(in_dates(F.col("dt"), start, end))
    return join_boxes(items, tiles, width, ("minx", "miny", "maxx", "maxy"))


def extent(items: DataFrame, key: str = "collection") -> DataFrame:
    """Spatial and temporal extent per collection."""
    return items.groupBy(key).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
        F.min("dt").alias("start"), F.max("dt").alias("end"), F.count(F.lit(1)).alias("n_items"),
    )


def extent_3d(items: DataFrame, key: str = "collection") -> DataFrame:
    """S9 with the z range."""
    z = items.groupBy(key).agg(F.min("minz").alias("minz"), F.max("maxz").alias("maxz"))
    return extent(items, key).join(z, key)


def extent_or_default(
    collections: DataFrame, items: DataFrame, key: str = "collection",
    box: tuple = (-180.0, -90.0, 180.0, 90.0),
) -> DataFrame:
    """S9 for all collections; an empty one gets the whole world and no dates."""
    joined = collections.join(extent(items, key), key, "left")
    for name, default in zip(("minx", "miny", "maxx", "maxy"), box):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(default)))
    return joined.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("bigint")))


def not_yet(new: DataFrame, known: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows whose key is not in the catalog or the output yet."""
    return new.join(known.select(key), key, "left_anti")


def build_items(
    listing: DataFrame, pattern: str, date: Column, known: DataFrame | None = None,
    exclude: list[str] | None = None, mode: str = "all",
) -> DataFrame:
    """One item per scene with one asset per polarisation or band.

    ``listing`` has path and the box of each file. ``pattern`` has two groups, the
    scene and the asset key. ``mode`` is 'all', 'new' (scenes not in ``known``) or
    'catalog_only' (scenes already known, rebuilt from the listing).
    """
    name = F.substring_index("path", "/", -1)
    files = listing.withColumn("file", name).where(names.matches(F.col("file"), pattern))
    if exclude:
        files = files.where(names.not_excluded(F.col("file"), exclude))
    files = files.withColumn("item_id", F.regexp_extract("file", pattern, 1)).withColumn(
        "asset", F.regexp_extract("file", pattern, 2)
    )
    # One path per (scene, asset): a partial aggregate, so a scene's list stays short.
    assets = files.groupBy("item_id", "asset").agg(
        F.min("path").alias("path"), F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    )
    built = assets.groupBy("item_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "path")))).alias("assets"),
        F.count(F.lit(1)).alias("n_assets"),
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    ).withColumn("dt", date)
    if mode == "new":
        return not_yet(built, known)
    if mode == "catalog_only":
        return built.join(known.select("item_id"), "item_id", "left_semi")
    return built


def offset_per_cloud(points: DataFrame, offsets: DataFrame | None = None, constant: float = 31.8684) -> DataFrame:
    """One vertical offset per tile added to z; without a table the constant."""
    if offsets is None:
        return points.withColumn("z", F.col("z") + F.lit(float(constant)))
    joined = points.join(offsets.select("tile_id", F.col("dz").alias("_dz")), "tile_id", "left")
    return joined.withColumn("z", F.col("z") + F.coalesce("_dz", F.lit(0.0))).drop("_dz")


def cell_offsets(points: DataFrame, model: DataFrame, step: float) -> DataFrame:
    """The offset of each tile, read from a gridded model at the tile's first point."""
    first = points.groupBy("tile_id").agg(
        F.min_by(F.struct("x", "y"), "pid").alias("_p")
    )
    keyed = first.select(
        "tile_id",
        F.floor(F.col("_p.y") / F.lit(float(step))).cast("int").alias("row"),
        F.floor(F.col("_p.x") / F.lit(float(step))).cast("int").alias("col"),
    )
    return keyed.join(model, ["row", "col"], "left").select("tile_id", "dz")
