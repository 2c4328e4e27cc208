"""Polygons as quadtree covers, so that points and pixels meet an area by an equi-join.

A polygon's box is laid out with a few coarse cells. Cells that many edges meet are split into four,
level by level and for all polygons at once, until a cell is met by no edge or by few. A cell
without edges lies inside or outside as a whole: inside cells need no further test, outside cells
are left out. A cell with edges keeps them, and the parity of its lower right corner: whether that
corner lies inside. From there a point's own parity follows from the cell's edges alone, along a
line up the right side and then to the left. A point is in one cell of a polygon at most.

Cell borders are shifted by odd fractions of a cell, so that vertices on a regular lattice do not
lie on them; where a vertex still does, ``cover`` takes another shift. An edge that runs exactly
through a cell's corner, between vertices, is the one case that is not looked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tileloom.operators.spatial import _edge_box
from tileloom.session import cut_lineage

#: Edges a cell may keep before it is split, and cells across a polygon's box at the start.
MOST_EDGES, ACROSS = 8, 8
#: Fractions of a cell by which borders are shifted in x and y, tried in turn. They differ, so that
#: lines of simple slopes through lattice points do not run through cell corners.
SHIFTS = ((0.38196601125, 0.7320508075), (0.6457513110, 0.1459023137), (0.2360679775, 0.8284271247))
#: An edge this close to a cell (in cell widths) counts as meeting it.
MARGIN = 1e-6
CELL = ["poly_id", "level", "cx", "cy"]
EDGE = ["x1", "y1", "x2", "y2"]


def _one(flag: Column) -> Column:
    return F.when(flag, 1).otherwise(0)


def _side(level: Column, width: float) -> Column:
    return F.lit(float(width)) * F.pow(F.lit(2.0), level)


def _cell_box(level: Column, cx: Column, cy: Column, width: float, shift: tuple) -> dict[str, Column]:
    side = _side(level, width)
    mx, my = (F.lit(width * s) for s in shift)
    return {
        "xmin": mx + cx * side, "ymin": my + cy * side,
        "xmax": mx + (cx + 1) * side, "ymax": my + (cy + 1) * side,
    }


def _meets(level: Column, cx: Column, cy: Column, width: float, shift: tuple) -> Column:
    """Whether the edge in x1..y2 meets the cell, widened by a margin."""
    box, margin = _cell_box(level, cx, cy, width, shift), _side(level, width) * F.lit(MARGIN)
    wide = {k: v - margin if k.endswith("min") else v + margin for k, v in box.items()}
    return _edge_box(wide, closed=True)


def _hit(e: dict[str, Column], px: Column, py: Column) -> Column:
    """The edge crosses the ray from (px, py) to the right; half-open in y."""
    up = (e["y1"] <= py) & (py < e["y2"])
    down = (e["y2"] <= py) & (py < e["y1"])
    return (up | down) & (e["x1"] + (py - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"]) > px)


def _step(e: dict[str, Column], px: Column, py: Column, right: Column, bottom: Column) -> Column:
    """How an edge changes the parity on the way from the corner (right, bottom) to a point."""
    side = ((e["x1"] <= right) & (right < e["x2"])) | ((e["x2"] <= right) & (right < e["x1"]))
    at = e["y1"] + (right - e["x1"]) * F.try_divide(e["y2"] - e["y1"], e["x2"] - e["x1"])
    return _one(side & (at > bottom) & (at <= py)) + _one(_hit(e, right, py)) + _one(_hit(e, px, py))


def _free_shift(polys: DataFrame, width: float) -> tuple:
    """A shift for which no vertex lies on a cell border."""
    def touching(shift):
        spots = [(F.col(c) - F.lit(width * shift[k % 2])) / F.lit(float(width)) for k, c in enumerate(EDGE)]
        return [F.max((s == F.floor(s)).cast("int")).alias(f"t{k}") for k, s in enumerate(spots)]

    for shift in SHIFTS:
        hit = polys.agg(F.greatest(*touching(shift)).alias("hit")).first()["hit"]
        if not hit:
            return shift
    raise ValueError("vertices lie on the cell borders of every shift; take another width")


def cover(polys: DataFrame, width: float, most_edges: int = MOST_EDGES) -> tuple[DataFrame, tuple]:
    """Cells (poly_id, level, cx, cy, start, edges) of the polygons, and the shift of their borders.

    ``polys`` has one row per edge (poly_id, x1, y1, x2, y2); several rings make holes by parity.
    A cell of level l is ``width * 2^l`` wide. ``edges`` is null for cells that lie inside; other
    cells keep at most ``most_edges`` of them, or all at level 0. ``start`` is the parity of the
    cell's lower right corner.
    """
    polys = cut_lineage(polys.select("poly_id", *EDGE).where("y1 <> y2 or x1 <> x2"))
    shift = _free_shift(polys, width)
    move_x, move_y = (F.lit(width * s) for s in shift)
    hull = polys.groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("hx1"), F.min(F.least("y1", "y2")).alias("hy1"),
        F.max(F.greatest("x1", "x2")).alias("hx2"), F.max(F.greatest("y1", "y2")).alias("hy2"),
    )
    extent = F.greatest(F.col("hx2") - F.col("hx1"), F.col("hy2") - F.col("hy1"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(extent / F.lit(float(width) * ACROSS)))).cast("int")
    hull = hull.withColumn("level", level)
    side = _side(F.col("level"), width)

    def cells(lo: Column, hi: Column, move: Column) -> Column:
        slack = side * F.lit(MARGIN)
        return F.explode(F.sequence(F.floor((lo - slack - move) / side), F.floor((hi + slack - move) / side)))

    roots = hull.withColumn("cx", cells(F.col("hx1"), F.col("hx2"), move_x)).withColumn(
        "cy", cells(F.col("hy1"), F.col("hy2"), move_y)
    ).select(CELL)
    spread = polys.join(hull.select("poly_id", "level"), "poly_id")
    rows = spread.withColumn("cy", cells(F.least("y1", "y2"), F.greatest("y1", "y2"), move_y))
    own = rows.withColumn("cx", cells(F.least("x1", "x2"), F.greatest("x1", "x2"), move_x))
    own = own.where(_meets(F.col("level"), F.col("cx"), F.col("cy"), width, shift)).select(*CELL, *EDGE)
    # The corners of a row of root cells: edges that cross the row's lower border, counted from the right.
    box = _cell_box(F.col("level"), F.col("cx"), F.col("cy"), width, shift)
    hits = roots.join(rows.select("poly_id", "cy", *EDGE), ["poly_id", "cy"]).where(_hit({c: F.col(c) for c in EDGE}, box["xmax"], box["ymin"]))
    odd = hits.groupBy(CELL).agg((F.count(F.lit(1)) % 2).cast("int").alias("start"))
    counts = own.groupBy(CELL).agg(F.count(F.lit(1)).alias("n"))
    front = roots.join(odd, CELL, "left").join(counts, CELL, "left").fillna(0, ["start", "n"])
    leaves = []
    while True:
        front = cut_lineage(front)
        whole = front.where("n = 0 and start = 1").select(*CELL, "start", F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>").alias("edges"))
        split = front.where((F.col("n") > most_edges) & (F.col("level") > 0))
        kept = front.where((F.col("n") > 0) & ((F.col("n") <= most_edges) | (F.col("level") == 0)))
        listed = own.join(kept.select(*CELL, "start"), CELL).groupBy(*CELL, "start").agg(
            F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in EDGE])).alias("edges")
        )
        leaves.append(cut_lineage(whole.unionByName(listed)))
        if split.isEmpty():
            break
        front, own = _quarters(own.join(split.select(*CELL, "start"), CELL), width, shift)
    out = leaves[0]
    for part in leaves[1:]:
        out = out.unionByName(part)
    return cut_lineage(out), shift


def _quarters(own: DataFrame, width: float, shift: tuple) -> tuple[DataFrame, DataFrame]:
    """The quarters of cells, given as rows (cell, start, edge): (cell, start, n) and (cell, edge)."""
    outer = _cell_box(F.col("level"), F.col("cx"), F.col("cy"), width, shift)
    parts = own.select(
        "*", outer["xmax"].alias("_r"), outer["ymin"].alias("_b"), F.explode(F.array(*[F.lit(q) for q in range(4)])).alias("_q")
    )
    quarter = parts.select(
        "poly_id", (F.col("level") - 1).alias("level"), (F.col("cx") * 2 + F.col("_q") % 2).alias("cx"),
        (F.col("cy") * 2 + F.floor(F.col("_q") / 2)).alias("cy"), "start", "_r", "_b", *EDGE,
    )
    inner = _cell_box(F.col("level"), F.col("cx"), F.col("cy"), width, shift)
    rows = cut_lineage(quarter.select(
        *CELL, *EDGE, "start", _step({c: F.col(c) for c in EDGE}, inner["xmax"], inner["ymin"], F.col("_r"), F.col("_b")).alias("_s"),
        _meets(F.col("level"), F.col("cx"), F.col("cy"), width, shift).alias("_m"),
    ))
    front = rows.groupBy(CELL).agg(
        ((F.max("start") + F.sum("_s")) % 2).cast("int").alias("start"), F.count(F.when(F.col("_m"), 1)).alias("n")
    )
    return front, rows.where("_m").select(*CELL, *EDGE)


def in_areas(spots: DataFrame, areas: tuple[DataFrame, tuple], width: float) -> DataFrame:
    """One row for each area a spot lies in: the columns of ``spots`` (with x and y) and area_id.

    ``areas`` comes from :func:`cover` with the same width. A spot looks up one cell on each level
    that the cover has; only spots in cells with edges are tested, against that cell's edges.
    """
    cells, shift = areas
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())
    if not levels:
        return spots.select("*", F.lit(None).cast(cells.schema["poly_id"].dataType).alias("area_id")).where(F.lit(False))
    at = [
        F.struct(F.lit(k).alias("level"), *[
            F.floor((F.col(c) - F.lit(width * s)) / F.lit(float(width) * 2**k)).alias(n)
            for c, n, s in (("x", "cx", shift[0]), ("y", "cy", shift[1]))
        ])
        for k in levels
    ]
    asked = spots.select(F.struct("*").alias("_spot"), "x", "y", F.explode(F.array(*at)).alias("_at"))
    found = asked.join(
        cells, (F.col("_at.level") == F.col("level")) & (F.col("_at.cx") == F.col("cx")) & (F.col("_at.cy") == F.col("cy"))
    )
    box = _cell_box(F.col("level"), F.col("cx"), F.col("cy"), width, shift)
    turns = F.aggregate("edges", F.col("start"), lambda n, e: n + _step({c: e[c] for c in EDGE}, F.col("x"), F.col("y"), box["xmax"], box["ymin"]))
    inside = F.col("edges").isNull() | (turns % 2 == 1)
    return found.where(inside).select("_spot.*", F.col("poly_id").alias("area_id"))


def points_in_areas(points: DataFrame, polys: DataFrame, width: float, most_edges: int = MOST_EDGES) -> DataFrame:
    """F16, several areas in one run: the points in each polygon, with its id as area_id.

    A point in several polygons comes once for each; a point on no polygon is left out. Points
    without coordinates lie nowhere.
    """
    return in_areas(points, cover(polys, width, most_edges), width)


def points_in_polygons(points: DataFrame, polys: DataFrame, width: float) -> DataFrame:
    """F16, polygon form: the points inside at least one polygon, each as often as it occurs."""
    spots = points.select("x", "y").distinct()
    inside = points_in_areas(spots, polys, width).select("x", "y").distinct()
    return points.join(inside, ["x", "y"], "left_semi").select(points.columns)


def pixels_in_areas(
    pixels: DataFrame, boxes: DataFrame, polys: DataFrame, resolution: float, width: float, key: list[str] | None = None
) -> DataFrame:
    """F16 for pixels: those whose centre lies in an area, with its id as area_id.

    ``boxes`` places the images: ``key`` (tile_id by default), xmin and ymax. Each place of an image is
    tested once, however many images and bands show it.
    """
    key = key or ["tile_id"]
    res = F.lit(float(resolution))
    spots = pixels.select(*key, "row", "col").distinct().join(boxes.select(*key, "xmin", "ymax"), key).select(
        *key, "row", "col", (F.col("xmin") + (F.col("col") + 0.5) * res).alias("x"),
        (F.col("ymax") - (F.col("row") + 0.5) * res).alias("y"),
    )
    hit = in_areas(spots, cover(polys, width), width).select(*key, "row", "col", "area_id")
    return pixels.join(hit, [*key, "row", "col"])
