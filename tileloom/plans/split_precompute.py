"""Hold-out split and the precompute job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tileloom.functions.draws import uniform
from tileloom.operators import imagery, neighbors, normalize, quality
from tileloom.operators.ranks import lowest_n, spare
from tileloom.operators.spatial import tiles_on_polygons
from tileloom.operators.voxel import cloud_digests, downsample_with_masks, still_valid
from tileloom.session import cut_lineage, written


MASKS = "tile_id string, cap int, start_cm double, ratio double, digest string, pid long, x double, y double, z double"


def random_part(tiles: DataFrame, ratio: float, seed) -> DataFrame:
    """int(n * ratio) tiles by hash, exactly."""
    (one,) = spare(tiles, "_all")
    keyed = tiles.withColumn(one, F.lit(0))
    draw = uniform(seed, F.col("tile_id"))
    part = lowest_n(keyed, [one], draw, lambda n: (n * F.lit(float(ratio))).cast("long"), ["tile_id"])
    return part.drop(one)


def split_tiles(checked: DataFrame, polys: DataFrame, width: float, test_ratio: float, seed) -> DataFrame:
    """Invalid, train, and test/val among the tiles that meet a hold-out polygon.

    ``checked`` is the table of validated, de-duplicated tiles with their boxes.
    """
    valid = checked.where(F.col("is_valid"))
    held = valid.select("tile_id").join(
        tiles_on_polygons(valid, polys, width).select("tile_id").distinct(), "tile_id", "left_semi"
    )
    test = random_part(held, test_ratio, seed).withColumn("_test", F.lit(True))
    marked = checked.select("tile_id", "is_valid", "reason_code").join(
        held.withColumn("_held", F.lit(True)), "tile_id", "left"
    ).join(test, "tile_id", "left")
    split = (
        F.when(~F.col("is_valid"), F.lit("invalid"))
        .when(F.col("_test"), F.lit("test"))
        .when(F.col("_held"), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return marked.select("tile_id", split.alias("split"), "reason_code")


def split_statistics(split: DataFrame) -> DataFrame:
    """Tiles per split and reason."""
    return split.groupBy("split", "reason_code").agg(F.count(F.lit(1)).alias("n_tiles"))


def _needed(attributes: list[str]) -> list[str]:
    """The columns of points that the job reads."""
    return list(dict.fromkeys(["tile_id", "cloud", "pid", "x", "y", "z", *attributes]))


def precompute(
    tiles: DataFrame, points: DataFrame, pixels: DataFrame, attributes: list[str], survey_date: str,
    point_stats: DataFrame, radar_stats: DataFrame, max_sparse: int = 10000, max_dense: int = 40000,
    start_cm: float = 4.0, ratio: float = 0.5, k: int = 16, cap_z: float = 95.0, seed="123",
    masks: DataFrame | None = None, graphs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """T5: capped, thinned and normalised points, the graph, and the dated images.

    ``masks`` and ``graphs`` are what an earlier run returned under these names: masks and edges of tiles
    whose cloud and settings are the same are used again, those of other tiles are made anew.
    """
    points = points.select(*_needed(attributes))
    sparse = quality.cap_points(points.where(F.col("cloud") == "dep"), "dep", max_sparse, seed)
    uav = points.where(F.col("cloud") == "uav")
    if masks is None:
        masks = points.sparkSession.createDataFrame([], MASKS)
    dense, masks = downsample_with_masks(uav, masks, max_dense, start_cm, ratio, keep_if_small=False)
    both = sparse.unionByName(dense)
    normed = normalize.normalise_to_box(both, tiles)
    normed = normalize.standardise_attributes(normed, attributes, point_stats)
    frame = normed.select(
        "tile_id", "cloud", "pid", F.col("x_norm").alias("x"), F.col("y_norm").alias("y"), F.col("z_norm").alias("z"),
        *[f"{a}_norm" for a in attributes], "center_x", "center_y", "center_z", "scale_x", "scale_y",
    )
    # Capped and thinned: far smaller than the input, and read by every output below. A second table without the
    # few tiles that are too high would take as much again.
    kept = quality.cap_height(written(frame), cap_z)
    cloud = kept.where(F.col("cloud") == "dep")
    digests = cut_lineage(cloud_digests(cloud))
    old = None if graphs is None else cut_lineage(still_valid(graphs.where(F.col("k") == k), digests))
    todo = cloud if old is None else cloud.join(old.select("tile_id").distinct(), "tile_id", "left_anti")
    edges = neighbors.edge_table(todo, k).join(digests, "tile_id")
    edges = written(edges if old is None else edges.unionByName(old.select(edges.columns)))
    alive = cut_lineage(kept.select("tile_id").distinct())
    optical = normalize.scale_optical(
        pixels.where(F.col("sensor") == "naip").join(alive, "tile_id", "left_semi")
    )
    radar = pixels.where(F.col("sensor") == "uavsar").join(alive, "tile_id", "left_semi")
    radar = quality.images_with_data(radar, ["tile_id", "image_id"])
    images = radar.select("tile_id", "image_id", "dt").distinct()
    slots = imagery.event_slots(imagery.acquisition_events(images, ["tile_id"]), ["tile_id"])
    reference = F.lit(survey_date).cast("date")
    slots = slots.withColumn("rel_days", F.date_diff("event_dt", reference).cast("float"))
    scaled = normalize.standardise_radar(radar, radar_stats).join(
        slots.select("tile_id", "image_id", "dt", "event_ix", "slot", "rel_days"), ["tile_id", "image_id", "dt"]
    )
    graph = edges.drop("digest")
    return {"points": kept, "edges": graph, "optical": optical, "radar": scaled, "events": slots, "masks": masks, "graphs": edges}


def split_and_precompute(
    checked: DataFrame, polys: DataFrame, width: float, points: DataFrame, pixels: DataFrame,
    attributes: list[str], survey_date: str, test_ratio: float = 0.6, seed="123", **options,
) -> dict[str, DataFrame]:
    """T4: split, statistics over all three valid sets, then one precompute job for all."""
    # A row per tile, read by several steps: the checks are made once.
    checked = written(checked)
    split = cut_lineage(split_tiles(checked, polys, width, test_ratio, seed))
    used = split.where(F.col("split") != "invalid").select("tile_id")
    # Written once, tile by tile: the statistics and every step of the job read them.
    pts = written(points.select(*_needed(attributes)).join(used, "tile_id", "left_semi"))
    px = pixels.join(used, "tile_id", "left_semi")
    point_stats = normalize.attribute_statistics(pts, attributes)
    radar_stats = normalize.band_statistics(px.where(F.col("sensor") == "uavsar"), "uavsar")
    point_stats, radar_stats = cut_lineage(point_stats), cut_lineage(radar_stats)
    out = precompute(
        checked, pts, px, attributes, survey_date, point_stats, radar_stats, seed=seed, **options
    )
    label = split.select("tile_id", "split")
    labelled = {name: df.join(label, "tile_id") for name, df in out.items()}
    return {**labelled, "split": split, "stats": point_stats.unionByName(radar_stats)}
