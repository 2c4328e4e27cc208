"""Points on an edge are no vertices, whatever rounding makes of their coordinates."""

from tileloom.operators import grid


def test_points_on_an_edge_are_no_vertices(spark):
    rows, want = [], {}
    for t in range(200):
        dx, dy = 3 + t % 17, 5 + t * 7 % 29
        line = [((t + dx * k) / 1000.7, (2 * t + dy * k) / 1000.9) for k in range(40)]
        third = ((t + dx * 45) / 1000.7, (2 * t + 3) / 1000.9)
        rows += [(f"t{t}", x, y) for x, y in [*line, third]]
        want[f"t{t}"] = {line[0], line[-1], third}
    points = spark.createDataFrame(rows, "tile_id string, x double, y double")
    got = {}
    for r in grid.convex_hull(points).collect():
        got.setdefault(r["tile_id"], []).append((r["x"], r["y"]))
    assert all(len(got[t]) == 3 and set(got[t]) == want[t] for t in want)
