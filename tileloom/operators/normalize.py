"""Statistics over valid values and the normalisations that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tileloom.functions.values import finite_or_null, is_finite, is_infinite, masked_z_score

FLAT = 1e-6


def value_statistics(rows: DataFrame, key: list[str], value: str = "v") -> DataFrame:
    """Mean and population deviation over finite values, NaN and Inf counts.

    A deviation under 1e-6 counts as 1; a key without any finite value has none.
    One pass, combined on the map side.
    """
    v = F.col(value)
    good = finite_or_null(v)
    found = rows.groupBy(*key).agg(
        F.avg(good).alias("mean"),
        F.stddev_pop(good).alias("_std"),
        F.count(good).alias("n"),
        F.count(F.when(F.isnan(v), 1)).alias("n_nan"),
        F.count(F.when(is_infinite(v), 1)).alias("n_inf"),
    )
    std = F.when(F.col("_std") < FLAT, F.lit(1.0)).otherwise(F.col("_std"))
    return found.where(F.col("n") > 0).select(*key, "mean", std.alias("std"), "n", "n_nan", "n_inf")


def band_statistics(pixels: DataFrame, kind: str) -> DataFrame:
    """G21 as rows of the statistics table."""
    return value_statistics(pixels, ["band"]).select(F.lit(kind).alias("kind"), "*")


def attribute_statistics(points: DataFrame, attributes: list[str], kind: str = "point") -> DataFrame:
    """Attributes to long form, then the same rule."""
    long = points.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("band"), F.col(a).cast("double").alias("v")) for a in attributes
    ])).alias("_a")).select("_a.band", "_a.v")
    return value_statistics(long, ["band"]).select(F.lit(kind).alias("kind"), "*")


def scale_optical(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Value / 255, invalid to 0."""
    v = F.col(value)
    return pixels.withColumn("norm", F.when(is_finite(v), v / F.lit(255.0)).otherwise(F.lit(0.0)))


def standardise_optical(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """X9, older form: z-score, invalid to 0. One statistics row per band."""
    v = F.col("v")
    joined = pixels.join(stats.select("band", "mean", "std"), "band")
    scored = F.try_divide(v - F.col("mean"), F.col("std"))
    valid = is_finite(v) & is_finite(scored)
    return joined.withColumn("norm", F.when(valid, scored).otherwise(F.lit(0.0))).drop("mean", "std")


def standardise_radar(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """Invalid to the mean, then z-score; the mask of invalid pixels stays."""
    joined = pixels.join(stats.select("band", "mean", "std"), "band")
    scored = F.try_divide(finite_or_null(F.col("v")) - F.col("mean"), F.col("std"))
    invalid = ~is_finite(F.col("v")) | (scored.isNotNull() & ~is_finite(scored))
    norm = masked_z_score(F.col("v"), F.col("mean"), F.col("std"))
    return joined.withColumn("is_invalid", invalid).withColumn("norm", norm).drop("mean", "std")


def standardise_attributes(points: DataFrame, attributes: list[str], stats: DataFrame) -> DataFrame:
    """X11: the statistics of all attributes as one row, then expressions only."""
    wide = stats.groupBy().agg(*[
        F.max(F.when(F.col("band") == a, F.struct("mean", "std"))).alias(a) for a in attributes
    ]).select(F.struct(*attributes).alias("s"))
    s = wide.scalar()
    out = points
    for a in attributes:
        z = masked_z_score(F.col(a).cast("double"), s[a]["mean"], s[a]["std"])
        out = out.withColumn(f"{a}_norm", z.cast("float"))
    return out


def normalise_to_box(points: DataFrame, tiles: DataFrame, side: float = 10.0) -> DataFrame:
    """X and y centred on the box and scaled to plus/minus half of ``side``, z from the joint minimum.

    ``tiles`` may hold one box per tile; adds x_norm, y_norm, z_norm and the centre and scale.
    """
    low = points.groupBy("tile_id").agg(F.min("z").alias("center_z"))
    frame = low.join(tiles.select("tile_id", "xmin", "ymin", "xmax", "ymax"), "tile_id").select(
        "tile_id",
        ((F.col("xmin") + F.col("xmax")) / 2).alias("center_x"),
        ((F.col("ymin") + F.col("ymax")) / 2).alias("center_y"),
        "center_z",
        ((F.col("xmax") - F.col("xmin")) / side).alias("scale_x"),
        ((F.col("ymax") - F.col("ymin")) / side).alias("scale_y"),
    )
    joined = points.join(frame, "tile_id")
    return (
        joined.withColumn("x_norm", (F.col("x") - F.col("center_x")) / F.col("scale_x"))
        .withColumn("y_norm", (F.col("y") - F.col("center_y")) / F.col("scale_y"))
        .withColumn("z_norm", F.col("z") - F.col("center_z"))
    )


def _shifted(points, frame):
    joined = points.join(frame, "tile_id")
    for axis in ("x", "y", "z"):
        joined = joined.withColumn(f"{axis}_norm", (F.col(axis) - F.col(f"c{axis}")) / F.col("scale"))
    return joined


def normalise_to_radius(points: DataFrame) -> DataFrame:
    """Both clouds of a tile around their common centroid, largest radius 1."""
    centre = points.groupBy("tile_id").agg(*[F.avg(a).alias(f"c{a}") for a in ("x", "y", "z")])
    off = [F.pow(F.col(a) - F.col(f"c{a}"), 2) for a in ("x", "y", "z")]
    reach = points.join(centre, "tile_id").groupBy("tile_id", "cx", "cy", "cz").agg(
        F.greatest(F.sqrt(F.max(off[0] + off[1] + off[2])), F.lit(1e-9)).alias("scale")
    )
    return _shifted(points, reach)


def normalise_to_extent(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """X13, box form: box centre and mean z, one scale for all axes."""
    seen = points.groupBy("tile_id").agg(
        F.avg("z").alias("cz"), (F.max("z") - F.min("z")).alias("_h")
    )
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.col("_h"))
    frame = seen.join(tiles.select("tile_id", "xmin", "ymin", "xmax", "ymax"), "tile_id").select(
        "tile_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"),
        ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"), "cz",
        F.greatest(side, F.lit(1e-9)).alias("scale"),
    )
    return _shifted(points, frame)


def grid_index(x: Column, y: Column, box: dict[str, Column], g: int) -> Column:
    """Row-major index in a g x g grid, clamped at all sides."""

    def cell(v, low, high):
        share = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        return F.least((share * F.lit(g)).cast("int"), F.lit(g - 1))

    return cell(y, box["ymin"], box["ymax"]) * g + cell(x, box["xmin"], box["xmax"])
