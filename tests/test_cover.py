"""Quadtree covers of polygons against the plain ray test."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tileloom.operators import cover


def ring(corners):
    return [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]


def star(cx, cy, n, seed, size=10.0):
    rnd = random.Random(seed)
    turns = [(2 * math.pi * k / n, size * (0.3 + 0.7 * rnd.random())) for k in range(n)]
    return ring([(cx + r * math.cos(t), cy + r * math.sin(t)) for t, r in turns])


POLYS = {
    "box": ring([(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)]),
    "hole": ring([(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)]) + ring([(5.0, 5.0), (15.0, 5.0), (15.0, 15.0), (5.0, 15.0)]),
    "star": star(10.0, 10.0, 200, 1),
    "far": star(1000.25, -500.5, 40, 2, 80.0),
    "tiny": ring([(3.001, 3.001), (3.003, 3.001), (3.002, 3.004)]),
    "crossed": ring([(0.0, 0.0), (12.0, 12.0), (12.0, 0.0), (0.0, 12.0)]),
    "flat": ring([(2.0, 2.0), (8.0, 2.0), (5.0, 2.0)]),
}


def edges(spark, polys):
    rows = [(name, 0, k, *e) for name, own in polys.items() for k, e in enumerate(own)]
    return spark.createDataFrame(rows, "poly_id string, ring_ix int, seg_ix int, x1 double, y1 double, x2 double, y2 double")


def inside(own, x, y):
    hits = sum(1 for x1, y1, x2, y2 in own if (y1 <= y < y2 or y2 <= y < y1) and x1 + (y - y1) * ((x2 - x1) / (y2 - y1)) > x)
    return hits % 2 == 1


def spots(spark):
    rnd = random.Random(3)
    at = [(rnd.uniform(-2, 22), rnd.uniform(-2, 22)) for _ in range(1500)]
    at += [(rnd.uniform(900, 1100), rnd.uniform(-600, -400)) for _ in range(500)]
    at += [(x / 4, y / 4) for x in range(-4, 84, 3) for y in range(-4, 84, 3)]
    at += [(3.002, 3.002), (3.0021, 3.0035), (1.0, 1.0), (5.0, 2.0), (1.0, 5.0), (9.0, 5.0)]
    return at, spark.createDataFrame([(k, x, y, "clash") for k, (x, y) in enumerate(at)], "pid int, x double, y double, level string")


@pytest.mark.parametrize("width, most", [(0.5, 8), (0.25, 1), (4.0, 2), (64.0, 8)])
def test_points_equal_the_ray_test(spark, width, most):
    at, points = spots(spark)
    found = cover.points_in_areas(points, edges(spark, POLYS), width, most)
    assert found.columns == ["pid", "x", "y", "level", "area_id"]
    got = sorted((r.pid, r.area_id) for r in found.collect())
    want = sorted((k, name) for k, (x, y) in enumerate(at) for name, own in POLYS.items() if inside(own, x, y))
    assert got == want


def test_nulls_repeats_and_empty_tables(spark):
    points = spark.createDataFrame([(1, 2.0, 2.0), (1, 2.0, 2.0), (2, None, 2.0), (3, 50.0, 50.0)], "pid int, x double, y double")
    polys = edges(spark, {"box": POLYS["box"]})
    assert [r.pid for r in cover.points_in_areas(points, polys, 1.0).collect()] == [1, 1]
    assert [r.pid for r in cover.points_in_polygons(points, polys, 1.0).collect()] == [1, 1]
    assert cover.points_in_areas(points, polys.limit(0), 1.0).collect() == []
    assert cover.points_in_areas(points.limit(0), polys, 1.0).collect() == []


def test_pixels_by_their_centres(spark):
    rows = [("t", s, r, c) for s in ("a", "b") for r in range(4) for c in range(4)]
    pixels = spark.createDataFrame(rows, "tile_id string, image_id string, row int, col int")
    boxes = spark.createDataFrame([("t", 0.0, 20.0)], "tile_id string, xmin double, ymax double")
    found = cover.pixels_in_areas(pixels, boxes, edges(spark, {"box": POLYS["box"], "hole": POLYS["hole"]}), 5.0, 1.0)
    got = sorted((r.area_id, r.image_id, r.row, r.col) for r in found.collect())
    want = [(n, s, r, c) for n in ("box", "hole") for s in "ab" for r in range(4) for c in range(4) if inside(POLYS[n], 2.5 + 5 * c, 17.5 - 5 * r)]
    assert got == sorted(want)


def edge_tests(spark, n_points, n_corners):
    """Edges that points are held against, over all boundary cells."""
    points = spark.range(n_points).select(F.col("id").alias("pid"), *[(F.pmod(F.xxhash64("id", F.lit(a)), F.lit(10**6)) / 10**6 * 24 - 2).alias(a) for a in "xy"])
    cells, shift = cover.cover(edges(spark, {"star": star(10.0, 10.0, n_corners, 5)}), 0.05)
    bounded = cells.where("edges is not null")
    assert bounded.where("level > 0").agg(F.max(F.size("edges"))).first()[0] <= cover.MOST_EDGES
    near = bounded.select("poly_id", "level", "cx", "cy", "start", "edges")
    found = cover.in_areas(points, (near.withColumn("poly_id", F.size("edges")).withColumn("edges", F.lit(None).cast(near.schema["edges"].dataType)), shift), 0.05)
    return found.agg(F.sum("area_id")).first()[0]


def test_edge_tests_grow_with_the_points_and_not_with_the_corners(spark):
    once, five = edge_tests(spark, 20000, 400), edge_tests(spark, 100000, 400)
    assert 4.5 * once < five < 5.5 * once
    # Plain bands would test 5 times as many edges a point; here cells shrink instead.
    assert edge_tests(spark, 20000, 2000) < 2 * once
