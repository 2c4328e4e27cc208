"""Grids as rows: one row per (tile, row, col), an absent row is an empty cell.

Two index rules exist side by side and must not be mixed: the truncating rule
(casting towards zero, last column closed) and the flooring rule (cells outside
the box are dropped).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tileloom.operators.ranks import HOT_GROUP_ROWS, has_hot_group, named_percentiles, percentiles
from tileloom.operators.spatial import in_box

CELL = ["tile_id", "row", "col"]
Builder = Callable[[Column], Column]
#: Side in cells of the blocks in which a grid is dealt to tasks.
BLOCK = 64


def fixed_box(xmin, ymin, xmax, ymax) -> dict[str, Column]:
    values = (xmin, ymin, xmax, ymax)
    return {n: F.lit(float(v)) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), values)}


def n_cells(low: Column, high: Column, res: float) -> Column:
    return F.ceil((high - low) / F.lit(float(res))).cast("int")


def trunc_index(v: Column, low: Column, high: Column, res: float) -> Column:
    """min(int((v - low) / res), cells - 1)."""
    return F.least(
        ((v - low) / F.lit(float(res))).cast("int"), n_cells(low, high, res) - F.lit(1)
    )


def floor_index(v: Column, low: Column, res: float) -> Column:
    return F.floor((v - low) / F.lit(float(res))).cast("int")


def with_cells(points: DataFrame, box: dict[str, Column], res: float) -> DataFrame:
    """G1's cell columns for the points inside the closed box."""
    inside = points.where(in_box(F.col("x"), F.col("y"), box))
    return inside.withColumn("row", trunc_index(F.col("y"), box["ymin"], box["ymax"], res)).withColumn(
        "col", trunc_index(F.col("x"), box["xmin"], box["xmax"], res)
    )


def cell_aggregate(
    points: DataFrame, box: dict[str, Column], res: float, agg: Builder, value: str = "z"
) -> DataFrame:
    """G1: any aggregate per cell. ``agg`` builds the aggregate from the value column."""
    return with_cells(points, box, res).groupBy(*CELL).agg(agg(F.col(value)).alias("v"))


def without_outliers(cells: DataFrame, value: str = "z", threshold: float = 3.0) -> DataFrame:
    """Keep |v - median| <= threshold * MAD per cell; keep all where MAD is 0."""
    middle = named_percentiles(cells, CELL, value, {"_med": 0.5})
    off = cells.join(middle, CELL).withColumn("_off", F.abs(F.col(value) - F.col("_med")))
    spread = named_percentiles(off, CELL, "_off", {"_mad": 0.5})
    near = (F.col("_mad") <= 0) | (F.col("_off") <= F.lit(float(threshold)) * F.col("_mad"))
    return off.join(spread, CELL).where(near).drop("_med", "_off", "_mad")


def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    low, high = (F.get(values, F.floor((n - o) / 2).cast("int")) for o in (1, 0))
    return F.when(n % 2 == 1, low.cast("double")).otherwise(F.lit(0.5) * low + F.lit(0.5) * high)


def _near_values(cells: DataFrame, value: str, threshold: float, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """G2 where nothing but the cell and the value is needed: a cell's values meet once, as one sorted array.

    Cells of more than ``hot_rows`` rows send all of them through :func:`without_outliers`.
    """
    rows = cells.select(*CELL, value)
    if has_hot_group(rows, CELL, hot_rows):
        return without_outliers(rows, value, threshold)
    listed = rows.repartition(*CELL).groupBy(*CELL).agg(F.sort_array(F.collect_list(value)).alias("_l"))
    listed = listed.withColumn("_med", _middle(F.col("_l")))
    off = lambda v: F.abs(v - F.col("_med"))
    listed = listed.withColumn("_mad", _middle(F.sort_array(F.transform("_l", off))))
    near = F.filter("_l", lambda v: (F.col("_mad") <= 0) | (off(v) <= F.lit(float(threshold)) * F.col("_mad")))
    return listed.select(*CELL, F.explode(near).alias(value))


def cell_aggregate_clean(points, box, res, agg, value="z", threshold=3.0) -> DataFrame:
    """G1 after G2."""
    kept = _near_values(with_cells(points, box, res), value, threshold)
    return kept.groupBy(*CELL).agg(agg(F.col(value)).alias("v"))


def full_grid(tiles: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Every cell of every tile."""
    return tiles.select(
        "tile_id", F.explode(F.sequence(F.lit(0), F.lit(nrows - 1))).alias("row")
    ).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))))


def fill_constant(cells: DataFrame, tiles: DataFrame, nrows: int, ncols: int, v: float = 0.0):
    """G3, constant form."""
    grid = full_grid(tiles, nrows, ncols).join(cells, CELL, "left")
    return grid.select(*CELL, F.coalesce("v", F.lit(float(v))).alias("v"))


def fill_nearest(cells: DataFrame, tiles: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """G3, nearest form: the value of the nearest occupied cell, ties by (row, col).

    A distance transform, one axis after the other. First every cell learns the nearest occupied
    row in its column (two running windows). The squared distance to that cell is a parabola over
    the columns of the row; the lowest parabola at each column belongs to the nearest occupied
    cell. The lower envelope of a row's parabolas is built in one pass, so a row costs as many
    steps as it has cells.
    """
    grid = full_grid(tiles, nrows, ncols).join(cells, CELL, "left")
    column = Window.partitionBy("tile_id", "col").orderBy("row")
    seen = F.when(F.col("v").isNotNull(), F.struct("row", F.col("v").cast("double").alias("v")))
    grid = grid.withColumn(
        "_below", F.last(seen, True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn(
        "_above", F.first(seen, True).over(column.rowsBetween(0, Window.unboundedFollowing))
    )
    nearer = F.col("_above").isNotNull() & (
        F.col("_below").isNull() | (F.col("_above.row") - F.col("row") < F.col("row") - F.col("_below.row"))
    )
    near = F.when(nearer, F.col("_above")).otherwise(F.col("_below"))
    lines = grid.withColumn("_s", near).select(*CELL, F.col("_s.row").alias("source"), F.col("_s.v").alias("v"))
    lines = lines.repartition("tile_id", "row").sortWithinPartitions("tile_id", "row", "col")
    schema = lines.select(*CELL, "v").schema
    return lines.mapInPandas(_nearest_in_lines(ncols), schema)


def _nearest_in_lines(ncols: int):
    """Rows of whole grid lines in column order: the value of the source with the lowest parabola."""

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            whole = len(held) // ncols * ncols
            if whole:
                yield filled(held.iloc[:whole])
                held = held.iloc[whole:]

    def filled(frame):
        source, v, row = (frame[n].to_numpy().reshape(-1, ncols) for n in ("source", "v", "row"))
        out = [
            [values[k] if k is not None else None for k in lowest_parabolas(at, int(own[0]), ncols)]
            for at, values, own in zip(source, v, row)
        ]
        return frame[CELL].assign(v=[x for line in out for x in line])

    return run


def lowest_parabolas(source, row: int, ncols: int) -> list[int | None]:
    """For each column of a grid line the column whose source is nearest, ties by the source's (row, col).

    ``source`` has the row of the nearest occupied cell of each column, or NaN. Distances are scaled,
    so that a tie rank fits below them; then no two parabolas meet at a whole column.
    """
    known = [(c, int(s)) for c, s in enumerate(source) if s == s]
    if not known:
        return [None] * ncols
    scale = (max(s for _, s in known) + 1) * ncols
    height = {c: scale * (s - row) ** 2 + s * ncols + c for c, s in known}
    stack: list[tuple[int, int]] = []  # (column of the parabola, first whole column where it is lowest)
    for c, _ in known:
        first = 0
        while stack:
            p, since = stack[-1]
            # c is below p from the first whole x with 2 * scale * x * (c - p) > the difference of heights at 0.
            first = (height[c] - height[p] + scale * (c * c - p * p)) // (2 * scale * (c - p)) + 1
            if first > since:
                break
            stack.pop()
        stack.append((c, max(first, 0) if stack else 0))
    out: list[int | None] = []
    for k, (c, since) in enumerate(stack):
        until = stack[k + 1][1] if k + 1 < len(stack) else ncols
        out += [c] * (min(until, ncols) - len(out))
    return out


def canopy_height(points, box, res: float = 1.0, surface_threshold: float = 3.0) -> DataFrame:
    """Surface (max after outlier removal), terrain (min) and their difference."""
    cells = with_cells(points, box, res)
    ground = cells.groupBy(*CELL).agg(F.min("z").alias("dtm"))
    top = _near_values(cells, "z", surface_threshold).groupBy(*CELL).agg(F.max("z").alias("dsm"))
    return top.join(ground, CELL).select(*CELL, "dsm", "dtm", (F.col("dsm") - F.col("dtm")).alias("chm"))


def max_surface(points: DataFrame, box: dict[str, Column], res: float) -> DataFrame:
    """Flooring indices, cells outside the box are dropped."""
    row, col = floor_index(F.col("y"), box["ymin"], res), floor_index(F.col("x"), box["xmin"], res)
    cells = points.withColumn("row", row).withColumn("col", col)
    inside = (
        (F.col("row") >= 0)
        & (F.col("col") >= 0)
        & (F.col("row") < n_cells(box["ymin"], box["ymax"], res))
        & (F.col("col") < n_cells(box["xmin"], box["xmax"], res))
    )
    return cells.where(inside).groupBy(*CELL).agg(F.max("z").alias("v"))


def min_surface(points: DataFrame, box: dict[str, Column], res: float) -> DataFrame:
    """Half-open box."""
    inside = points.where(in_box(F.col("x"), F.col("y"), box, closed=False))
    row = ((F.col("y") - box["ymin"]) / F.lit(float(res))).cast("int")
    col = ((F.col("x") - box["xmin"]) / F.lit(float(res))).cast("int")
    return (
        inside.withColumn("row", row).withColumn("col", col).groupBy(*CELL).agg(F.min("z").alias("v"))
    )


def progressive_ground(
    cells: DataFrame, res: float, first: int = 3, last: int = 21, slope: float = 0.15
) -> DataFrame:
    """Progressive morphological filter on a min-Z grid.

    Erosion by a square window is a minimum along the row, then along the column,
    as two range windows over one grid line each. Cells that mirror at the grid
    edge lie inside the window anyway, so no padding is needed. Empty cells are
    skipped, where an array filter would spread their NaN.
    """
    grid = cells
    for window in range(first, last + 1, 2):
        half = window // 2
        along_row = Window.partitionBy("tile_id", "row").orderBy("col").rangeBetween(-half, half)
        along_col = Window.partitionBy("tile_id", "col").orderBy("row").rangeBetween(-half, half)
        step = F.lit(slope * window * res)
        grid = (
            grid.withColumn("_m", F.min("v").over(along_row))
            .withColumn("_e", F.min("_m").over(along_col))
            .withColumn(
                "v", F.when(F.col("v") - F.col("_e") > step, F.col("_e") + step).otherwise(F.col("v"))
            )
            .select(*CELL, "v")
        )
    return grid


def idw_surface(
    cells: DataFrame,
    box: tuple[float, float, float, float],
    res: float,
    power: float = 2.0,
    radius: float | None = None,
    nodes: str = "centre",
) -> DataFrame:
    """Inverse distance weighting over the occupied cell centres of a min-Z grid.

    ``nodes='centre'`` puts the targets on cell centres, ``'linspace'`` on evenly
    spaced nodes from edge to edge. With a radius, source and target meet on a
    bucket of that size; without one every occupied cell of the tile counts by
    definition, and the pairs are cells, never points.
    """
    x0, y0, x1, y1 = box
    nx, ny = math.ceil((x1 - x0) / res), math.ceil((y1 - y0) / res)
    half = res / 2
    if nodes == "centre":
        tx, ty = F.lit(x0 + half) + F.col("col") * res, F.lit(y0 + half) + F.col("row") * res
    else:
        tx = F.lit(float(x0)) + F.col("col") * F.lit(nx * res / max(nx - 1, 1))
        ty = F.lit(float(y0)) + F.col("row") * F.lit(ny * res / max(ny - 1, 1))
    reach = float(radius) if radius is not None else 2.0 * max(nx, ny) * res
    tiles = cells.select("tile_id").distinct()
    targets = full_grid(tiles, ny, nx).withColumn("tx", tx).withColumn("ty", ty)
    targets = targets.withColumn("_bx", F.floor((F.col("tx") - x0) / reach).cast("int")).withColumn(
        "_by", F.floor((F.col("ty") - y0) / reach).cast("int")
    )
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    sx, sy = F.lit(x0 + half) + F.col("col") * res, F.lit(y0 + half) + F.col("row") * res
    sources = cells.select("tile_id", sx.alias("sx"), sy.alias("sy"), "v")
    sources = (
        sources.withColumn("_ox", F.explode(around))
        .withColumn("_oy", F.explode(around))
        .select(
            "tile_id", "sx", "sy", "v",
            (F.floor((F.col("sx") - x0) / reach).cast("int") + F.col("_ox")).alias("_bx"),
            (F.floor((F.col("sy") - y0) / reach).cast("int") + F.col("_oy")).alias("_by"),
        )
    )
    dist = F.sqrt(F.pow(F.col("sx") - F.col("tx"), 2) + F.pow(F.col("sy") - F.col("ty"), 2))
    pairs = targets.join(sources, ["tile_id", "_bx", "_by"]).withColumn("_d", dist)
    if radius is not None:
        pairs = pairs.where(F.col("_d") < F.lit(float(radius)))
    w = F.when(F.col("_d") > 0, F.lit(1.0) / F.pow(F.col("_d"), F.lit(float(power))))
    exact = F.when(F.col("_d") == 0, F.col("v"))
    found = pairs.groupBy(*CELL).agg(
        F.min(exact).alias("_hit"), F.sum(w * F.col("v")).alias("_wv"), F.sum(w).alias("_w")
    )
    return found.select(*CELL, F.coalesce("_hit", F.try_divide("_wv", "_w")).alias("v"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def _dealt(cells: DataFrame) -> DataFrame:
    """Blocks of neighbouring cells in one task each, which sums what its cells add before a shuffle."""
    return cells.repartition("tile_id", *[F.floor(F.col(c) / F.lit(BLOCK)) for c in ("row", "col")])


def _added(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL).agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def gaussian_smooth(full: DataFrame, nrows: int, ncols: int, sigma: float = 1.0) -> DataFrame:
    """Separable Gaussian over a full grid, one pass along rows and one along columns.

    Each source cell, and each of its mirror images beyond the edges, adds to the few target
    cells its kernel reaches (a fixed number of offsets), by a partial aggregate.
    """
    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    kernel = F.array(*[F.lit(w) for w in weights])
    out = full
    for axis, n in (("row", nrows), ("col", ncols)):
        turns = [2 * n * k for k in range(-(reach // (2 * n)) - 1, reach // (2 * n) + 2)]
        images = F.array(*[i + F.lit(t) for t in turns for i in (F.col(axis), F.lit(2 * n - 1) - F.col(axis))])
        low = F.greatest(F.col("_at") - F.lit(reach), F.lit(0))
        high = F.least(F.col("_at") + F.lit(reach), F.lit(n - 1))
        met = _dealt(out).withColumn("_at", F.explode(images)).where(low <= high).withColumn(axis, F.explode(F.sequence(low, high)))
        out = _added(met.withColumn("_w", F.get(kernel, (F.col("_at") - F.col(axis) + F.lit(reach)).cast("int"))))
    return out


def upsample_bilinear(full: DataFrame, nrows: int, ncols: int, factor: float) -> DataFrame:
    """Finer grid with both end cells kept in place, linear between neighbours.

    Each cell adds to the finer cells between its neighbours, by a partial aggregate.
    """
    met = _dealt(full).withColumn("_w", F.lit(1.0))
    for axis, n in (("row", nrows), ("col", ncols)):
        m = int(round(n * factor))
        step = (n - 1) / max(m - 1, 1)
        low = F.floor((F.col("_s") - 1) / F.lit(step)) - 1 if step else F.lit(0)
        high = F.ceil((F.col("_s") + 1) / F.lit(step)) + 1 if step else F.lit(m - 1)
        low, high = F.greatest(low.cast("int"), F.lit(0)), F.least(high.cast("int"), F.lit(m - 1))
        met = met.withColumnRenamed(axis, "_s").where(low <= high).withColumn(axis, F.explode(F.sequence(low, high)))
        met = met.withColumn("_f", F.col(axis) * F.lit(step))
        met = met.withColumn("_b", F.least(F.floor("_f").cast("int"), F.lit(max(n - 2, 0))))
        met = met.where((F.col("_s") - F.col("_b")).isin(0, 1))
        part = F.col("_f") - F.col("_b")
        met = met.withColumn("_w", F.col("_w") * F.when(F.col("_s") > F.col("_b"), part).otherwise(F.lit(1.0) - part)).drop("_s", "_f", "_b")
    return _added(met.where(F.col("_w") != 0))


def smoothed_terrain(
    points: DataFrame,
    box: tuple[float, float, float, float],
    coarse: float = 2.5,
    fine: float = 1.0,
    sigma: float = 1.0,
    threshold: float = 5.0,
    fill: str = "nearest",
) -> DataFrame:
    """Coarse minimum grid, filled, smoothed, then refined.

    ``fill='zero'`` gives the older behaviour of smoothing over zeros.
    """
    x0, y0, x1, y1 = box
    nrows, ncols = math.ceil((y1 - y0) / coarse), math.ceil((x1 - x0) / coarse)
    ground = cell_aggregate_clean(points, fixed_box(*box), coarse, F.min, "z", threshold)
    tiles = points.select("tile_id").distinct()
    if fill == "nearest":
        full = fill_nearest(ground, tiles, nrows, ncols)
    else:
        full = fill_constant(ground, tiles, nrows, ncols, 0.0)
    smooth = gaussian_smooth(full, nrows, ncols, sigma)
    return upsample_bilinear(smooth, nrows, ncols, coarse / fine)


def coverage(
    points: DataFrame,
    box: dict[str, Column],
    res: float = 1.0,
    min_points: int = 1,
    min_pct: float = 80.0,
) -> DataFrame:
    """Share of cells holding enough points; points outside count in the edge cell.

    The average is over occupied cells. A box with at most one cell on an axis
    gives zeros and is never complete.
    """
    def cells_on(low, high):
        return ((high - low) / F.lit(float(res)) + F.lit(1e-6)).cast("int")

    nx, ny = cells_on(box["xmin"], box["xmax"]), cells_on(box["ymin"], box["ymax"])
    cx = F.greatest(F.lit(0), F.least(((F.col("x") - box["xmin"]) / res).cast("int"), nx - 1))
    cy = F.greatest(F.lit(0), F.least(((F.col("y") - box["ymin"]) / res).cast("int"), ny - 1))
    per_cell = (
        points.select("tile_id", cy.alias("row"), cx.alias("col"), nx.alias("_nx"), ny.alias("_ny"))
        .groupBy("tile_id", "_nx", "_ny", "row", "col")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    thin = (F.col("_nx") <= 1) | (F.col("_ny") <= 1)
    found = per_cell.groupBy("tile_id", "_nx", "_ny").agg(
        F.sum(F.when(F.col("_n") >= min_points, 1).otherwise(0)).alias("_covered"),
        F.avg("_n").alias("_avg"),
    )
    total = F.col("_nx") * F.col("_ny")
    pct = F.coalesce(F.try_divide(F.col("_covered").cast("double"), total) * F.lit(100.0), F.lit(0.0))
    zero = F.lit(0)
    return found.select(
        "tile_id",
        F.when(thin, zero).otherwise(total).cast("bigint").alias("total_cells"),
        F.when(thin, zero).otherwise(F.col("_covered")).cast("bigint").alias("covered_cells"),
        F.when(thin, F.lit(0.0)).otherwise(pct).alias("coverage_pct"),
        F.when(thin, F.lit(0.0)).otherwise(F.col("_avg")).alias("avg_points_per_occupied_cell"),
        (~thin & (pct >= min_pct)).alias("is_complete"),
    )


def raster_cells(points: DataFrame, res: float, mode: str = "compat", keys: tuple = ("tile_id",)) -> DataFrame:
    """G11's cell columns: a raster over each cloud's own extent, y axis pointing down.

    ``mode='compat'`` uses rounded widths and drops cells outside the array, also
    the lowest line that the flip can push past the last row; ``mode='grid'`` uses
    the G1 rule. A cloud is what shares the ``keys``.
    """
    extent = points.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    r = F.lit(float(res))
    rows = points.join(extent, list(keys))
    if mode == "compat":
        width = F.rint((F.col("_x1") - F.col("_x0")) / r).cast("int")
        height = F.rint((F.col("_y1") - F.col("_y0")) / r).cast("int")
        col = ((F.col("x") - F.col("_x0")) / r).cast("int")
        row = (height - (F.col("y") - F.col("_y0")) / r).cast("int")
        inside = (col >= 0) & (col < width) & (row >= 0) & (row < height)
        rows = rows.where(inside)
    else:
        col = trunc_index(F.col("x"), F.col("_x0"), F.col("_x1"), res)
        row = n_cells(F.col("_y0"), F.col("_y1"), res) - 1 - trunc_index(F.col("y"), F.col("_y0"), F.col("_y1"), res)
    return rows.withColumn("row", row).withColumn("col", col)


def raster_array(
    points: DataFrame, res: float, agg: Builder | None, value: str = "hag", ps=None, mode: str = "compat"
) -> DataFrame:
    """Raster of any statistic over each cloud's own extent (see :func:`raster_cells`).

    With ``ps`` (percentiles in [0, 1]) the output has one row per band. A statistic that no
    column expression gives goes through ``cell_states`` instead.
    """
    cells = raster_cells(points, res, mode)
    if ps is None:
        return cells.groupBy(*CELL).agg(agg(F.col(value)).alias("v"))
    found = percentiles(cells, CELL, value, ps)
    return found.select(*CELL, F.posexplode("q").alias("band", "v"))


def back_to_points(
    points: DataFrame, cells: DataFrame, box: dict[str, Column], res: float, nrows: int, ncols: int, out: str = "agg_val"
) -> DataFrame:
    """The value of each point's cell, the index clipped to the grid; NaN cells give NULL."""
    row = F.greatest(F.lit(0), F.least(((F.col("y") - box["ymin"]) / res).cast("int"), F.lit(nrows - 1)))
    col = F.greatest(F.lit(0), F.least(((F.col("x") - box["xmin"]) / res).cast("int"), F.lit(ncols - 1)))
    keyed = points.withColumn("row", row).withColumn("col", col)
    return keyed.join(cells.select(*CELL, F.col("v").alias(out)), CELL, "left")


def standard_rasters(points: DataFrame, box: dict[str, Column], res: float, value: str = "hag") -> DataFrame:
    """Min, max, mean, count and standard deviation per cell in one pass."""
    v = F.col(value)
    return with_cells(points, box, res).groupBy(*CELL).agg(
        F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"),
        F.count(v).alias("v_count"), F.stddev_pop(v).alias("v_std"),
    )


def raster_difference(
    a: DataFrame, b: DataFrame, keys: list[str], group: list[str], clip_p: float = 0.95
) -> DataFrame:
    """A - b per cell, clipped to plus/minus a percentile of the absolute difference.

    ``keys`` may include a band column (n-band form); ``group`` is what shares a limit.
    """
    diff = a.select(*keys, F.col("v").alias("_a")).join(b.select(*keys, F.col("v").alias("_b")), keys)
    diff = diff.withColumn("d", F.col("_a") - F.col("_b")).withColumn("_abs", F.abs(F.col("d")))
    limit = named_percentiles(diff, group, "_abs", {"lim": clip_p})
    clipped = F.least(F.greatest(F.col("d"), -F.col("lim")), F.col("lim"))
    return diff.join(limit, group).select(*keys, "d", clipped.alias("d_clipped"))


def stack_bands(*rasters: DataFrame) -> DataFrame:
    """Rasters as bands 0, 1, 2, ... of one table."""
    out = None
    for band, raster in enumerate(rasters):
        named = raster.withColumn("band", F.lit(band))
        out = named if out is None else out.unionByName(named)
    return out


# --- footprints --------------------------------------------------------------


def valid_footprint(pixels: DataFrame, res: float, nodata: float = 0.0) -> DataFrame:
    """Number of valid cells and their area per raster."""
    valid = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") != F.lit(float(nodata)))
    return pixels.groupBy("tile_id").agg(
        F.count(F.when(valid, 1)).alias("n_valid"),
        (F.count(F.when(valid, 1)) * F.lit(res * res)).alias("area"),
    )


def covered_windows(pixels: DataFrame, size: int, nodata: float = 0.0) -> DataFrame:
    """G25, containment: size x size pixel windows of a raster in which every pixel is valid."""
    valid = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") != F.lit(float(nodata)))
    windows = pixels.where(valid).groupBy(
        "tile_id", F.floor(F.col("row") / size).alias("wr"), F.floor(F.col("col") / size).alias("wc")
    ).agg(F.count(F.lit(1)).alias("_n"))
    return windows.where(F.col("_n") == size * size).select("tile_id", "wr", "wc")


def convex_hull(points: DataFrame, rows_per_strip: int = 1 << 18) -> DataFrame:
    """Hull vertices per cloud, counter-clockwise from the leftmost lowest one.

    Exact, without sampling. A vertex of the whole is also a vertex of any part that holds it, so
    ``rows_per_strip`` rows at a time are replaced by the vertices of their clouds' parts where they lie. Only
    these travel; a cloud's are merged in the same way, as they come, so that no call holds a giant tile.
    """
    kind = points.schema["tile_id"].dataType.simpleString()
    spots = points.select("tile_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y")])
    spots = spots.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    parts = spots.mapInArrow(lambda batches: _hulls(batches, rows_per_strip, False), f"tile_id {kind}, x double, y double")
    return parts.repartition("tile_id").mapInArrow(
        lambda batches: _hulls(batches, rows_per_strip, True), f"tile_id {kind}, ix int, x double, y double"
    )


def _hulls(batches, most: int, last: bool):
    """The hull vertices of the rows so far, whenever ``most`` have come; ``last``: of all rows, numbered."""
    held, rows, limit = [], 0, most
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= limit:
            found = _hull_rows(pa.Table.from_batches(held)).drop_columns("ix")
            held, rows = found.to_batches(), len(found)
            if last:
                limit = max(most, 2 * rows)
            else:
                yield from held
                held, rows = [], 0
    if rows:
        found = _hull_rows(pa.Table.from_batches(held))
        yield from (found if last else found.drop_columns("ix")).to_batches()


#: Turns to the left by less than this (radians) are rounding: points on a line stay on it.
STRAIGHT = 1e-13


def _chain(pts):
    """One monotone chain of points (x, y, row); a point that does not turn left is dropped."""
    out = []
    for x, y, at in pts:
        while len(out) > 1:
            (ax, ay, _), (bx, by, _) = out[-2:]
            turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if turn > STRAIGHT * math.hypot(bx - ax, by - ay) * math.hypot(x - ax, y - ay):
                break
            out.pop()
        out.append((x, y, at))
    return out


#: Directions of the points that bound a cloud from within; what lies inside of them by this share of its extent is no vertex.
AROUND = [(math.cos(k * math.pi / 8), math.sin(k * math.pi / 8)) for k in range(16)]
INSIDE = 1e-9


def _hull_rows(table: pa.Table) -> pa.Table:
    """tile_id, ix, x, y: the hull vertices of every tile's points."""
    table = table.combine_chunks()
    tile = pc.dictionary_encode(table["tile_id"], null_encoding="encode").combine_chunks().indices.to_numpy()
    x, y = (table[c].to_numpy() for c in ("x", "y"))
    order = np.lexsort((y, x, tile))
    new = np.diff(tile[order], prepend=-1) != 0
    order = order[new | (np.diff(x[order], prepend=np.nan) != 0) | (np.diff(y[order], prepend=np.nan) != 0)]
    order = order[_may_bound(tile[order], x[order], y[order])]
    tile, x, y = tile[order], x[order], y[order]
    starts = np.flatnonzero(np.diff(tile, prepend=-1))
    at, ix = [], []
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)]):
        pts = list(zip(x[begin:end].tolist(), y[begin:end].tolist(), range(begin, end)))
        if len(pts) > 2:
            pts = _chain(pts)[:-1] + _chain(pts[::-1])[:-1]
        at += [p[2] for p in pts]
        ix += range(len(pts))
    at = np.array(at, np.int64)
    spots = {"x": pa.array(x[at]), "y": pa.array(y[at])}
    return pa.table({"tile_id": table["tile_id"].take(pa.array(order[at])), "ix": pa.array(ix, pa.int32()), **spots})


def _may_bound(tile: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False for points well inside a polygon of their tile's outermost points; the rows are sorted by tile."""
    starts = np.flatnonzero(np.diff(tile, prepend=-1))
    if not len(starts):
        return np.zeros(0, bool)
    of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(tile)))
    corners, kept = [], np.zeros(len(tile), bool)
    for dx, dy in AROUND:
        reach = x * dx + y * dy
        hit = np.flatnonzero(reach == np.maximum.reduceat(reach, starts)[of])
        corner = starts.copy()
        corner[of[hit[::-1]]] = hit[::-1]
        corners.append(corner)
        kept[corner] = True
    extent = np.maximum.reduceat(x, starts) - np.minimum.reduceat(x, starts)
    extent = np.maximum(extent, np.maximum.reduceat(y, starts) - np.minimum.reduceat(y, starts))
    inside = np.isfinite(extent)[of]
    for p, q in zip(corners, [*corners[1:], corners[0]]):
        ex, ey = x[q] - x[p], y[q] - y[p]
        least = INSIDE * extent * np.hypot(ex, ey)
        cross = ex[of] * (y - y[p][of]) - ey[of] * (x - x[p][of])
        inside &= (cross > least[of]) | (p == q)[of]
    return kept | ~inside
