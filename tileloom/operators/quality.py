"""Filters and checks on points and tiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tileloom.functions.values import is_finite
from tileloom.operators.grid import coverage
from tileloom.operators.ranks import lowest_n, numbered_within


# --- point filters -----------------------------------------------------------


def ground(points: DataFrame) -> DataFrame:
    """class 2."""
    return points.where(F.col("classification") == 2)


def first_returns(points: DataFrame) -> DataFrame:
    return points.where(F.col("return_number") == 1)


def without_noise(points: DataFrame) -> DataFrame:
    """classes 7 and 18 removed."""
    return points.where(~F.col("classification").isin(7, 18))


def height_range(points: DataFrame, low: float, high: float, height: str = "hag") -> DataFrame:
    return points.where(F.col(height).between(low, high))


def cap_points(points: DataFrame, cloud: str, n: int, seed) -> DataFrame:
    """A random n of the tiles' larger clouds, everything of the smaller ones."""
    from tileloom.functions.draws import uniform

    draw = uniform(seed, F.col("tile_id"), F.col("pid"))
    chosen = points.where(F.col("cloud") == cloud)
    rest = points.where(F.col("cloud") != cloud)
    return rest.unionByName(lowest_n(chosen, ["tile_id"], draw, n, ["x", "y", "z", "pid"]))


def common_union(*clouds: DataFrame) -> DataFrame:
    """union over the columns all clouds share, in the order of the first."""
    shared = [c for c in clouds[0].columns if all(c in d.columns for d in clouds)]
    return reduce(lambda a, b: a.unionByName(b), [d.select(*shared) for d in clouds])


# --- tile level --------------------------------------------------------------


def counts_by_cloud(points: DataFrame, clouds: tuple = ("uav", "dep")) -> DataFrame:
    return points.groupBy("tile_id").agg(
        *[F.count(F.when(F.col("cloud") == c, 1)).alias(f"n_{c}") for c in clouds]
    )


def enough_points(tiles_or_points: DataFrame, points: DataFrame, cloud: str, least: int) -> DataFrame:
    """keep only tiles whose cloud is large enough, before anything costly is joined."""
    large = (
        points.where(F.col("cloud") == cloud)
        .groupBy("tile_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= least)
    )
    return tiles_or_points.join(large, "tile_id", "left_semi")


def in_area_by_centre(tiles: DataFrame, points: DataFrame, area: tuple) -> DataFrame:
    """keep tiles whose centre lies in the area.

    The centre is the stored one, else that of the box, else that of the points.
    ``tiles`` has center_x, center_y and the box, each possibly NULL.
    """
    seen = points.groupBy("tile_id").agg(
        ((F.min("x") + F.max("x")) / 2).alias("_px"), ((F.min("y") + F.max("y")) / 2).alias("_py")
    )
    joined = tiles.join(seen, "tile_id", "left")
    cx = F.coalesce("center_x", (F.col("xmin") + F.col("xmax")) / 2, "_px")
    cy = F.coalesce("center_y", (F.col("ymin") + F.col("ymax")) / 2, "_py")
    x0, y0, x1, y1 = (F.lit(float(v)) for v in area)
    placed = joined.withColumn("cx", cx).withColumn("cy", cy)
    return placed.where(F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1)).drop("_px", "_py")


def study_area(cx: Column, cy: Column, area: tuple, first: str, second: str) -> Column:
    """the first area when the centre lies in it, else the second."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in area)
    return F.when(cx.between(x0, x1) & cy.between(y0, y1), F.lit(first)).otherwise(F.lit(second))


# Reason codes in the order of the checks.
REASONS = (
    "missing_uav", "few_uav", "missing_bbox", "low_coverage", "missing_dep", "few_dep", "low_ratio",
)


def validate_tiles(
    tiles: DataFrame,
    points: DataFrame,
    min_uav: int = 10000,
    min_dep: int = 500,
    min_coverage: float = 80.0,
    min_per_cell: int = 1,
    min_ratio: float | None = None,
    res: float = 1.0,
) -> DataFrame:
    """one row per tile with ``is_valid``, a reason code and the reason's text.

    ``tiles`` carries tile_id and the box; ``points`` tile_id, cloud, x, y in the
    same coordinates. Counts and coverage are two partial aggregates over points.
    """
    box = {c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}
    has_box = F.col("xmin").isNotNull()
    counts = counts_by_cloud(points)
    boxes = tiles.where(has_box).select("tile_id", *box)
    uav = points.where(F.col("cloud") == "uav").select("tile_id", "x", "y").join(boxes, "tile_id")
    cover = coverage(uav, box, res, min_per_cell, min_coverage)
    rows = (
        tiles.join(counts, "tile_id", "left")
        .join(cover.select("tile_id", "coverage_pct", "is_complete"), "tile_id", "left")
        .withColumn("n_uav", F.coalesce("n_uav", F.lit(0).cast("bigint")))
        .withColumn("n_dep", F.coalesce("n_dep", F.lit(0).cast("bigint")))
    )
    ratio = F.try_divide(F.col("n_uav").cast("double"), F.col("n_dep"))
    checks = [
        (F.col("n_uav") == 0, F.lit("the tile has no UAV points")),
        (
            F.col("n_uav") < min_uav,
            F.format_string("UAV points: %d, wanted %d", "n_uav", F.lit(min_uav)),
        ),
        (~has_box, F.lit("the tile has no box")),
        (
            ~F.coalesce("is_complete", F.lit(False)),
            F.format_string(
                f"covered by UAV points: %.1f%%, wanted {min_coverage:g}%%",
                F.coalesce("coverage_pct", F.lit(0.0)),
            ),
        ),
        (F.col("n_dep") == 0, F.lit("the tile has no DEP points")),
        (
            F.col("n_dep") < min_dep,
            F.format_string("DEP points: %d, wanted %d", "n_dep", F.lit(min_dep)),
        ),
    ]
    if min_ratio is not None:
        checks.append((
            ratio < float(min_ratio),
            F.format_string(f"UAV points per DEP point: %.2f, wanted {min_ratio:g}", ratio),
        ))
    code, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (failed, message) in reversed(list(zip(REASONS, checks))):
        code = F.when(failed, F.lit(name)).otherwise(code)
        text = F.when(failed, message).otherwise(text)
    return rows.withColumn("reason_code", code).withColumn("reason", text).withColumn(
        "is_valid", F.col("reason_code").isNull()
    )


def valid_shapes(
    counts: DataFrame, surface: DataFrame, min_uav: int = 2000, min_dep: int = 50,
    ratio: float = 1.5, side: int = 10,
) -> DataFrame:
    """F8: size and density rule; the surface table must span side x side cells."""
    shape = surface.groupBy("tile_id").agg(
        (F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols")
    )
    good = (
        (F.col("n_uav") >= min_uav)
        & (F.col("n_dep") >= min_dep)
        & (F.col("n_dep") * F.lit(float(ratio)) <= F.col("n_uav"))
        & (F.col("_rows") == side)
        & (F.col("_cols") == side)
    )
    return counts.join(shape, "tile_id").where(good).drop("_rows", "_cols")


def first_of_duplicates(rows: DataFrame, order: list[str], key: str = "tile_id") -> DataFrame:
    """the first row per id by ``order``; rows without an id all stay."""
    named = rows.where(F.col(key).isNotNull())
    # The whole row as one struct: a partial aggregate, no sort of a group.
    record = F.struct(*rows.columns)
    kept = named.groupBy(key).agg(F.min_by(record, F.struct(*order)).alias("_r")).select("_r.*")
    return kept.select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))


def duplicate_counts(rows: DataFrame, key: str = "tile_id") -> DataFrame:
    """extra occurrences per id."""
    found = rows.where(F.col(key).isNotNull()).groupBy(key)
    return found.agg((F.count(F.lit(1)) - 1).alias("n_extra")).where(F.col("n_extra") > 0)


def cap_height(points: DataFrame, cap: float = 95.0, least_share: float = 0.8) -> DataFrame:
    """UAV points above the cap go; a tile that would lose too many goes whole."""
    low = F.col("z") <= float(cap)
    share = points.where(F.col("cloud") == "uav").groupBy("tile_id").agg(
        F.avg(F.when(low, 1.0).otherwise(0.0)).alias("_share")
    )
    good = share.where(F.col("_share") >= float(least_share)).select("tile_id")
    kept = points.where((F.col("cloud") != "uav") | low)
    return kept.join(good, "tile_id", "left_semi")


def images_with_data(pixels: DataFrame, key: list[str]) -> DataFrame:
    """drop images in which no pixel is finite."""
    seen = pixels.where(is_finite(F.col("v"))).select(*key).distinct()
    return pixels.join(seen, key, "left_semi")


def augmentation_violations(
    points: DataFrame, pixels: DataFrame | None = None, cloud: str = "dep",
    min_points: int = 500, max_abs: float = 300.0, attributes: tuple = ("intensity",),
) -> DataFrame:
    """(tile_id, violation) for every broken rule."""
    coords = [F.col(c) for c in ("x", "y", "z")]
    bad = reduce(lambda a, b: a | b, [F.isnan(c) for c in coords])
    inf = reduce(lambda a, b: a | b, [F.abs(c) == float("inf") for c in coords])
    big = F.max(F.greatest(*[F.abs(c) for c in coords]))
    found = points.where(F.col("cloud") == cloud).groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(bad).alias("_nan"), F.max(inf).alias("_inf"), big.alias("_big"),
        F.count(reduce(lambda a, b: F.when(a.isNotNull(), b), [F.col(a) for a in attributes])).alias("_na"),
    )
    rules = F.array_compact(F.array(
        F.when(F.col("_n") < min_points, F.lit("too_few_points")),
        F.when(F.col("_nan"), F.lit("nan_points")),
        F.when(F.col("_inf"), F.lit("inf_points")),
        F.when(F.col("_big") > max_abs, F.lit("extreme_points")),
        F.when(F.col("_na") != F.col("_n"), F.lit("attribute_count")),
    ))
    out = found.select("tile_id", F.explode(rules).alias("violation"))
    if pixels is None:
        return out
    images = pixels.groupBy("tile_id", "sensor").agg(
        F.max(F.isnan("v")).alias("_nan"), F.max(F.abs(F.col("v")) == float("inf")).alias("_inf")
    )
    image_rules = F.array_compact(F.array(
        F.when(F.col("_nan"), F.concat(F.lit("nan_"), "sensor")),
        F.when(F.col("_inf"), F.concat(F.lit("inf_"), "sensor")),
    ))
    return out.unionByName(images.select("tile_id", F.explode(image_rules).alias("violation")))


def first_item_per_date(items: DataFrame, most: int | None = None) -> DataFrame:
    """the first item (by id) of each calendar date; with ``most``, of that many first dates."""
    record = F.struct(*items.columns)
    first = items.groupBy(F.to_date("dt").alias("_d")).agg(F.min_by(record, "item_id").alias("_r"))
    if most is not None:
        first = first.orderBy("_d").limit(most)
    return first.select("_r.*")


def reason_histogram(checked: DataFrame) -> DataFrame:
    """Tiles per reason code."""
    bad = checked.where(~F.col("is_valid"))
    return bad.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n_tiles"))


def tile_summary(points: DataFrame, a: str = "dep", b: str = "uav") -> DataFrame:
    """Counts and extents per cloud side by side, with differences of the bounds."""
    aggs = []
    for cloud in (a, b):
        mine = F.col("cloud") == cloud
        aggs.append(F.count(F.when(mine, 1)).alias(f"n_{cloud}"))
        for axis in ("x", "y", "z"):
            aggs.append(F.min(F.when(mine, F.col(axis))).alias(f"{axis}_min_{cloud}"))
            aggs.append(F.max(F.when(mine, F.col(axis))).alias(f"{axis}_max_{cloud}"))
    wide = points.groupBy("tile_id").agg(*aggs)
    for axis in ("x", "y", "z"):
        for end in ("min", "max"):
            gap = F.col(f"{axis}_{end}_{b}") - F.col(f"{axis}_{end}_{a}")
            wide = wide.withColumn(f"{axis}_{end}_diff", gap)
    return wide


def latest_per_key(rows: DataFrame, key: list[str], when: Column, tiebreak: list[str]) -> DataFrame:
    """The last row by time per key; a missing time sorts first."""
    record = F.struct(*rows.columns)
    order = F.struct(F.coalesce(when, F.lit("0001-01-01").cast("timestamp")), *tiebreak)
    return rows.groupBy(*key).agg(F.max_by(record, order).alias("_r")).select("_r.*")


def time_ordered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Position of each item in its tile's time order, from 1; a tile's items may lie in many tasks."""
    return numbered_within(rows, key, ["dt", "item_id"], "pos").withColumn("pos", (F.col("pos") + 1).cast("int"))
