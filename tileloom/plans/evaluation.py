"""The evaluation frame: distances and canopy metrics of every model per tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tileloom.operators import canopy, metrics
from tileloom.operators.neighbors import both_ways
from tileloom.operators.report import samples_by_model
from tileloom.session import written

METRICS = ["chamfer_distance", "dcd", "infocd", "point_count"]


def model_distances(points: DataFrame, truth: str, models: list[str]) -> DataFrame:
    """M1, M5 and M6 of every model cloud against the truth, in long form.

    All models share one nearest-neighbour pass, in which a tile's points travel once. What the three metrics
    sum is taken from its rows as they come; only these sums are written.
    """
    nn = both_ways(points, models, truth, want=["d2", "d1", "n_shared"])
    # Tile and model are one key as JSON, which tells them apart whatever signs an id has.
    key = F.to_json(F.struct("tile_id", F.col("cloud").alias("model")))
    sums = written(metrics.match_sums(nn, ["tile_id", "cloud", "side"])).withColumn("tile_id", key).drop("cloud")
    counts = metrics.side_counts(sums)
    found = (
        metrics.chamfer_squared(sums)
        .join(metrics.density_aware(sums, counts), "tile_id")
        .join(metrics.info_chamfer(sums), "tile_id")
        .join(counts, "tile_id")
    )
    values = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("v"))
        for m, c in (("chamfer_distance", "chamfer_distance"), ("dcd", "dcd"), ("infocd", "infocd"), ("point_count", "n_a"))
    ])
    key = F.from_json("tile_id", "tile_id string, model string")
    return found.select(key.alias("_k"), F.explode(values).alias("_m")).select(
        "_k.tile_id", "_k.model", "_m.metric", "_m.v"
    )


def evaluation_frame(
    points: DataFrame, tiles: DataFrame, truth: str, models: list[str], require: str = "any", **canopy_options
) -> DataFrame:
    """One row per tile with the metrics of all models, canopy change and the box."""
    wide = samples_by_model(model_distances(points, truth, models), models, METRICS, require)
    change = canopy.canopy_height_change(points, models[0], truth, **canopy_options)
    boxes = tiles.select("tile_id", "xmin", "ymin", "xmax", "ymax")
    return wide.join(change, "tile_id", "left").join(boxes, "tile_id", "left")
