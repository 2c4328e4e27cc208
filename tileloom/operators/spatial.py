"""Boxes, cells and polygons: every spatial join carries an equi key.

Boxes are exploded to the coarse cells they touch and joined on the cell. A pair
met in several cells is kept only in the cell that holds the lower left corner of
the common box, so no distinct over pairs is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


def with_point_cell(df: DataFrame, width: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("cx", F.floor(F.col(x) / F.lit(float(width)))).withColumn(
        "cy", F.floor(F.col(y) / F.lit(float(width)))
    )


def with_box_cells(df: DataFrame, width: float, box: tuple = BOX) -> DataFrame:
    """One row per coarse cell the closed box touches."""
    w = F.lit(float(width))
    lo = [F.floor(F.col(c) / w) for c in box[:2]]
    hi = [F.floor(F.col(c) / w) for c in box[2:]]
    return df.withColumn("cx", F.explode(F.sequence(lo[0], hi[0]))).withColumn(
        "cy", F.explode(F.sequence(lo[1], hi[1]))
    )


def boxes_touch(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """closed intersection, a shared edge counts."""
    return (
        (a["xmin"] <= b["xmax"])
        & (a["xmax"] >= b["xmin"])
        & (a["ymin"] <= b["ymax"])
        & (a["ymax"] >= b["ymin"])
    )


def in_box(x: Column, y: Column, box: dict[str, Column], closed: bool = True) -> Column:
    """closed on all sides, or half-open as the min-Z grids want it."""
    low = (x >= box["xmin"]) & (y >= box["ymin"])
    if closed:
        return low & (x <= box["xmax"]) & (y <= box["ymax"])
    return low & (x < box["xmax"]) & (y < box["ymax"])


def join_boxes(
    left: DataFrame,
    right: DataFrame,
    width: float,
    left_box: tuple = BOX,
    right_box: tuple = BOX,
    extra: Column | None = None,
) -> DataFrame:
    """Pairs of touching boxes (J1's spatial part). Column names must not overlap."""
    a = with_box_cells(left, width, left_box)
    b = with_box_cells(right, width, right_box)
    ac = dict(zip(BOX, (F.col(c) for c in left_box)))
    bc = dict(zip(BOX, (F.col(c) for c in right_box)))
    w = F.lit(float(width))
    owner = (F.floor(F.greatest(ac["xmin"], bc["xmin"]) / w) == F.col("cx")) & (
        F.floor(F.greatest(ac["ymin"], bc["ymin"]) / w) == F.col("cy")
    )
    pairs = a.join(b, ["cx", "cy"]).where(boxes_touch(ac, bc) & owner)
    if extra is not None:
        pairs = pairs.where(extra)
    return pairs.drop("cx", "cy")


def any_box(df: DataFrame, boxes: DataFrame, width: float, box: tuple, boxes_box: tuple) -> DataFrame:
    """F1, any-of form: rows whose box touches at least one of the boxes.

    Distinct boxes are tested; the rows themselves are kept or left out as often as they occur.
    """
    a = with_box_cells(df.select(*box).distinct(), width, box)
    b = with_box_cells(boxes, width, boxes_box)
    touch = boxes_touch(
        dict(zip(BOX, (a[c] for c in box))), dict(zip(BOX, (b[c] for c in boxes_box)))
    )
    same = (a["cx"] == b["cx"]) & (a["cy"] == b["cy"])
    hits = a.join(b, same & touch, "left_semi").select(*box).distinct()
    return df.join(hits, list(box), "left_semi").select(*df.columns)


def points_to_tiles(points: DataFrame, tiles: DataFrame, width: float) -> DataFrame:
    """Every (point, tile) match under closed edges; tiles may overlap.

    A point lies in one coarse cell and a tile of the cell width touches at most
    four, so the tile side is the one that is exploded. Columns of ``tiles`` that
    the points also have must be renamed by the caller.
    """
    p = with_point_cell(points, width)
    t = with_box_cells(tiles, width)
    box = {c: F.col(c) for c in BOX}
    return (
        p.join(t, ["cx", "cy"]).where(in_box(F.col("x"), F.col("y"), box)).drop("cx", "cy")
    )


# --- polygons as edge lists --------------------------------------------------


def _edge_bands(polys: DataFrame, height: float) -> DataFrame:
    h = F.lit(float(height))
    lo = F.floor(F.least("y1", "y2") / h)
    hi = F.floor(F.greatest("y1", "y2") / h)
    return polys.select(
        "poly_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(lo, hi)).alias("band")
    )


def _ray_hit(px: Column, py: Column) -> Column:
    """The edge crosses the ray from (px, py) to the right; half-open in y."""
    up = (F.col("y1") <= py) & (py < F.col("y2"))
    down = (F.col("y2") <= py) & (py < F.col("y1"))
    at = F.col("x1") + (py - F.col("y1")) * F.try_divide(
        F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    )
    return (up | down) & (at > px)


def _edge_box(box: dict[str, Column], closed: bool) -> Column:
    """The edge meets the closed box, or passes through the open one."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    sides = [
        dx * (y - F.col("y1")) - dy * (x - F.col("x1"))
        for x in (box["xmin"], box["xmax"])
        for y in (box["ymin"], box["ymax"])
    ]
    least, most = F.least(*sides), F.greatest(*sides)
    xl, xh = F.least("x1", "x2"), F.greatest("x1", "x2")
    yl, yh = F.least("y1", "y2"), F.greatest("y1", "y2")
    if closed:
        near = (xh >= box["xmin"]) & (xl <= box["xmax"]) & (yh >= box["ymin"]) & (yl <= box["ymax"])
        return near & (least <= 0) & (most >= 0)
    near = (xh > box["xmin"]) & (xl < box["xmax"]) & (yh > box["ymin"]) & (yl < box["ymax"])
    return near & (least < 0) & (most > 0)


def tiles_on_polygons(
    tiles: DataFrame, polys: DataFrame, width: float, mode: str = "intersects"
) -> DataFrame:
    """(tile_id, poly_id) pairs where the tile meets, or lies in, the polygon.

    Candidates come from the polygon's box. Edges are joined per polygon and y
    band, so a polygon with many edges is never read whole for one tile. A tile
    meets a polygon when an edge meets the closed box or a corner is inside; it
    lies in it when no edge passes through the open box and its centre is inside.
    """
    if mode not in ("intersects", "contained"):
        raise ValueError("mode must be 'intersects' or 'contained'")
    inside = mode == "contained"
    hull = polys.groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("p_xmin"),
        F.min(F.least("y1", "y2")).alias("p_ymin"),
        F.max(F.greatest("x1", "x2")).alias("p_xmax"),
        F.max(F.greatest("y1", "y2")).alias("p_ymax"),
    )
    found = join_boxes(
        tiles.select("tile_id", *BOX), hull, width, BOX, ("p_xmin", "p_ymin", "p_xmax", "p_ymax")
    ).select("tile_id", "poly_id", *BOX)
    h = F.lit(float(width))
    bands = F.sequence(F.floor(F.col("ymin") / h), F.floor(F.col("ymax") / h))
    box = {c: F.col(c) for c in BOX}
    if inside:
        px, py = (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2
    else:
        px, py = box["xmin"], box["ymin"]
    pairs = found.withColumn("band", F.explode(bands)).join(
        _edge_bands(polys, width), ["poly_id", "band"]
    )
    crosses = _ray_hit(px, py) & (F.col("band") == F.floor(py / h))
    verdict = pairs.groupBy("tile_id", "poly_id").agg(
        F.sum(F.when(crosses, 1).otherwise(0)).alias("_rays"),
        F.max(_edge_box(box, closed=not inside)).alias("_edge"),
    )
    odd = F.col("_rays") % 2 == 1
    keep = (odd & ~F.col("_edge")) if inside else (odd | F.col("_edge"))
    return verdict.where(keep).select("tile_id", "poly_id")


# --- tiling ------------------------------------------------------------------


def tile_boxes(
    boxes: DataFrame, width: float, height: float, overlap: float = 0.0, key: str = "area_id"
) -> DataFrame:
    """Tiles that fit whole into each box, row by row from the lower left corner."""
    if not 0.0 <= overlap < 1.0:
        raise ValueError("overlap must be in [0, 1)")
    sx, sy = F.lit(width * (1.0 - overlap)), F.lit(height * (1.0 - overlap))
    slack = F.lit(1e-9)
    nx = F.floor((F.col("xmax") - F.col("xmin") - F.lit(float(width))) / sx + slack)
    ny = F.floor((F.col("ymax") - F.col("ymin") - F.lit(float(height))) / sy + slack)
    rows = boxes.where((nx >= 0) & (ny >= 0)).select(
        key, F.col("xmin").alias("_x"), F.col("ymin").alias("_y"),
        nx.alias("_nx"), F.explode(F.sequence(F.lit(0).cast("long"), ny)).alias("iy"),
    )
    grid = rows.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nx"))))
    xmin, ymin = F.col("_x") + F.col("ix") * sx, F.col("_y") + F.col("iy") * sy
    return grid.select(
        key, "ix", "iy", xmin.alias("xmin"), ymin.alias("ymin"),
        (xmin + F.lit(float(width))).alias("xmax"), (ymin + F.lit(float(height))).alias("ymax"),
    )


def tiles_over_polygons(
    polys: DataFrame, size: float = 10.0, overlap: float = 0.15, mode: str = "contained"
) -> DataFrame:
    """Tiles of each polygon's box that lie in (or meet) that polygon."""
    hull = polys.groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("xmin"),
        F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.max(F.greatest("y1", "y2")).alias("ymax"),
    )
    tiles = tile_boxes(hull, size, size, overlap, key="poly_id").withColumn(
        "tile_id", F.concat_ws("_", "poly_id", "ix", "iy")
    )
    kept = tiles_on_polygons(tiles, polys, size, mode)
    own = tiles.select("tile_id", "poly_id", "ix", "iy", *BOX)
    return own.join(kept, ["tile_id", "poly_id"], "left_semi")
