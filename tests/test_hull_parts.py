"""The hull of a cloud from the hulls of its parts: points inside don't travel, and many tiles share a call."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileloom.operators import grid

SCHEMA = "tile_id string, x double, y double"


def plain(pts):
    """Hull vertices of whole coordinates, counter-clockwise from the leftmost lowest one."""
    pts = sorted(set(pts))
    if len(pts) < 3:
        return pts

    def chain(some):
        out = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1])


def clouds():
    rng = np.random.default_rng(2)
    made = {f"t{n}": [tuple(map(float, p)) for p in rng.integers(0, 40, (n, 2))] for n in (1, 2, 3, 5, 30, 700)}
    made["line"] = [(float(k), float(3 * k)) for k in range(50)]
    made["spot"] = [(2.0, 2.0)] * 9
    made["far"] = [(float(p) * 1e6, float(q)) for p, q in rng.integers(-30, 30, (400, 2))]
    made[None] = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (1.0, 1.0)]
    return made


@pytest.mark.parametrize("rows", [7, 1 << 18])
def test_hull_of_parts_is_the_hull(spark, rows):
    made = clouds()
    points = [(t, *p) for t, pts in made.items() for p in pts]
    np.random.default_rng(1).shuffle(order := list(range(len(points))))
    df = spark.createDataFrame([points[i] for i in order] + [("t5", None, 1.0), ("t5", float("nan"), 1.0)], SCHEMA)
    got = {}
    for r in sorted(grid.convex_hull(df, rows_per_strip=rows).collect(), key=lambda r: r.ix):
        got.setdefault(r.tile_id, []).append((r.x, r.y))
        assert r.ix == len(got[r.tile_id]) - 1
    assert got == {t: plain(pts) for t, pts in made.items()}


def test_only_vertices_of_parts_travel(spark):
    points = spark.range(40_000, numPartitions=2).select(
        F.concat(F.lit("t"), F.floor(F.col("id") % 10_000 / 1000)).alias("tile_id"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1.0).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1.0).alias("y"),
    )
    hull = grid.convex_hull(points)
    assert hull._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert len({r.tile_id for r in hull.collect()}) == 10
    batches = points.toArrow().to_batches()
    parts = sum(len(b) for b in grid._hulls(iter(batches), 5000, False))
    assert parts < points.count() / 20
