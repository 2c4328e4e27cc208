"""Both directions of a search: points travel once, and only the columns asked for come back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileloom.operators import metrics, neighbors

SCHEMA = "tile_id string, cloud string, pid long, x double, y double, z double, nx double, ny double, nz double"


def cloud_rows(tile, n_a, n_b, seed, grid):
    rng = np.random.default_rng(seed)
    # Whole coordinates: many equally far neighbours and points on one spot.
    spots = rng.integers(0, grid, (n_a + n_b, 3)).astype(float)
    return [(tile, "a" if i < n_a else "b", i, *map(float, s), float(i % 7 + 1), float(i % 5), 1.0) for i, s in enumerate(spots)]


def brute(rows):
    out = {}
    for tile in {r[0] for r in rows}:
        sides = {s: [r for r in rows if r[0] == tile and r[1] == s] for s in "ab"}
        for side, mine, other in (("ab", "a", "b"), ("ba", "b", "a")):
            for p in sides[mine]:
                if sides[other]:
                    best = min(sides[other], key=lambda q: (sum((p[c] - q[c]) ** 2 for c in (3, 4, 5)), q[3:6], q[2]))
                    out[tile, side, p[2]] = best[2], sum((p[c] - best[c]) ** 2 for c in (3, 4, 5)), best[6:9]
    return out


ROWS = [*cloud_rows("few", 30, 90, 1, 6), *cloud_rows("more", 60, 40, 2, 30), *cloud_rows("many", 20, 200, 3, 9), *cloud_rows("alone", 5, 0, 4, 3)]


@pytest.mark.parametrize("leaf", [neighbors.LEAF, 4])
def test_rows_equal_a_comparison_of_all_pairs(spark, leaf):
    """With leaves of 4 the tile of 200 goes by the tree and the others are compared."""
    points = spark.createDataFrame(ROWS + ROWS[:20], SCHEMA)
    axes = ["nx", "ny", "nz"]
    want = ["pid", "n_pid", "d2", "n_shared", *[f"n_{c}" for c in axes]]
    found = neighbors.both_ways(points, "a", "b", leaf=leaf, want=want, carry=axes).collect()
    truth = brute(ROWS)
    assert {(r.tile_id, r.side, r.pid): (r.n_pid, r.d2, (r.n_nx, r.n_ny, r.n_nz)) for r in found} == truth
    assert len(found) == len(truth)
    shared = {}
    for (tile, side, _), (n, _, _) in truth.items():
        shared[tile, side, n] = shared.get((tile, side, n), 0) + 1
    assert all(r.n_shared == shared[r.tile_id, r.side, r.n_pid] for r in found)


def test_points_travel_once_and_unread_columns_are_not_made(spark):
    points = spark.createDataFrame(ROWS, SCHEMA)
    nn = neighbors.both_ways(points, "a", "b", want=["d2"])
    assert nn.columns == ["tile_id", "side", "d2"]
    plan = nn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CoGroup" not in plan


def test_metrics_are_the_same_with_carried_columns(spark):
    points = spark.createDataFrame(ROWS, SCHEMA)
    axes = ["nx", "ny", "nz"]
    rows = lambda df: sorted((r[0], round(r[1], 9)) for r in df.collect())
    whole = neighbors.both_ways(points, "a", "b")
    carried = neighbors.both_ways(points, "a", "b", want=[*axes, *[f"n_{c}" for c in axes]], carry=axes)
    assert rows(metrics.normals_distance(carried)) == rows(metrics.normals_distance(whole, points.select("tile_id", "pid", *axes)))
    counts = points.groupBy("tile_id").agg(F.count(F.when(F.col("cloud") == "a", 1)).alias("n_a"), F.count(F.when(F.col("cloud") == "b", 1)).alias("n_b"))
    shared = neighbors.both_ways(points, "a", "b", want=["d2", "n_shared"])
    assert rows(metrics.density_aware(shared, counts)) == rows(metrics.density_aware(whole, counts))
