"""Grids whose cells add to their targets, against sums written down plainly."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tileloom.operators import grid, imagery


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lattice(spark, nrows, ncols, seed, share=1.0):
    rnd = random.Random(seed)
    cells = {(t, r, c): rnd.uniform(-5, 5) for t in "ab" for r in range(nrows) for c in range(ncols) if rnd.random() < share}
    return spark.createDataFrame([(*k, v) for k, v in cells.items()], "tile_id string, row int, col int, v double"), cells


def same(df, want):
    got = {(r["tile_id"], r["row"], r["col"]): r["v"] for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("nrows, ncols, sigma", [(4, 4, 1.0), (1, 3, 1.0), (9, 5, 2.0)])
def test_smoothing_adds_mirrored_cells_without_a_join(spark, monkeypatch, nrows, ncols, sigma):
    monkeypatch.setattr(grid, "BLOCK", 2)
    full, cells = lattice(spark, nrows, ncols, 1)
    weights = grid.gaussian_weights(sigma)
    mirror = lambda i, n: min(i % (2 * n), 2 * n - 1 - i % (2 * n))
    for axis, n in ((1, nrows), (2, ncols)):
        at = lambda k, i: (*k[:axis], mirror(i, n), *k[axis + 1:])
        cells = {k: sum(w * cells[at(k, k[axis] + o - len(weights) // 2)] for o, w in enumerate(weights)) for k in cells}
    smooth = grid.gaussian_smooth(full, nrows, ncols, sigma)
    same(smooth, cells)
    assert "Join" not in plan(smooth)


@pytest.mark.parametrize("nrows, ncols, factor", [(4, 4, 2.5), (1, 6, 3.0), (7, 3, 0.5), (5, 2, 1.0)])
def test_refining_adds_corners_without_a_join(spark, monkeypatch, nrows, ncols, factor):
    monkeypatch.setattr(grid, "BLOCK", 2)
    full, cells = lattice(spark, nrows, ncols, 2, 0.8)
    want = {}
    for t in "ab":
        for r in range(round(nrows * factor)):
            for c in range(round(ncols * factor)):
                fr = r * ((nrows - 1) / max(round(nrows * factor) - 1, 1))
                fc = c * ((ncols - 1) / max(round(ncols * factor) - 1, 1))
                br, bc = min(math.floor(fr), max(nrows - 2, 0)), min(math.floor(fc), max(ncols - 2, 0))
                parts = [
                    w * cells[(t, br + i, bc + j)] for i in (0, 1) for j in (0, 1)
                    if (w := (fr - br if i else 1 - (fr - br)) * (fc - bc if j else 1 - (fc - bc))) and (t, br + i, bc + j) in cells
                ]
                if parts:
                    want[(t, r, c)] = sum(parts)
    fine = grid.upsample_bilinear(full, nrows, ncols, factor)
    same(fine, want)
    assert "Join" not in plan(fine)


@pytest.mark.parametrize("threshold", [0.5, 1.5, 3.0])
def test_values_without_outliers_meet_once(spark, threshold):
    rnd = random.Random(3)
    rows = [("t", rnd.randrange(3), rnd.randrange(3), rnd.choice([1.0, 2.0, 2.0, rnd.gauss(0, 9)])) for _ in range(200)]
    rows += [("flat", 0, 0, 5.0)] * 4 + [("flat", 0, 0, 9.0), ("none", 0, 0, None), ("some", 0, 0, None), ("some", 0, 0, 4.0)]
    cells = spark.createDataFrame(rows, "tile_id string, row int, col int, z double")
    want = grid.without_outliers(cells, "z", threshold).where("z is not null").select("tile_id", "row", "col", "z")
    for hot in (10, 1000):
        got = grid._near_values(cells, "z", threshold, hot).where("z is not null")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    kept = grid._near_values(cells, "z", threshold)
    assert "Join" not in plan(kept)


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("source, target, res", [
    ((0.0, 10.0, 2.0), (0.3, 0.4, 9.1, 9.1), 1.3), ((1.0, 9.0, 0.5), (-2.0, -1.0, 12.0, 11.0), 3.1), ((0.0, 10.0, 1.0), (0.0, 0.0, 10.0, 10.0), 1.0),
])
def test_regridding_equals_all_targets_without_a_join(spark, monkeypatch, method, source, target, res):
    monkeypatch.setattr(imagery, "BLOCK", 2)
    pixels, cells = lattice(spark, 8, 9, 4, 0.7)
    x0, y1, sres = source
    offsets = {"nearest": [0], "bilinear": [0, 1], "cubic": [-1, 0, 1, 2]}[method]

    def weight(t):
        s = abs(t)
        if method == "nearest":
            return 1.0
        if method == "bilinear":
            return max(1 - s, 0.0)
        return 1.5 * s**3 - 2.5 * s**2 + 1 if s <= 1 else -0.5 * s**3 + 2.5 * s**2 - 4 * s + 2 if s < 2 else 0.0

    want, half = {}, 0.5 if method == "nearest" else 0.0
    for t in "ab":
        for r in range(math.ceil((target[3] - target[1]) / res)):
            for c in range(math.ceil((target[2] - target[0]) / res)):
                fx = (target[0] + (c + 0.5) * res - x0) / sres - 0.5
                fy = (y1 - (target[3] - (r + 0.5) * res)) / sres - 0.5
                spots = [(t, math.floor(fy + half) + i, math.floor(fx + half) + j) for i in offsets for j in offsets]
                parts = [(weight(fy - k[1]) * weight(fx - k[2]), cells[k]) for k in spots if k in cells]
                total = sum(w for w, _ in parts)
                want[(t, r, c)] = sum(w * v for w, v in parts) / total if total else -9.0
    made = imagery.regrid(pixels, ["tile_id"], source, target, res, method, -9.0)
    same(made, want)
    assert "Join" not in plan(made)


def test_an_image_without_values_is_filled(spark):
    pixels = spark.createDataFrame([("a", 0, 0, None), (None, 0, 0, 1.0)], "tile_id string, row int, col int, v double")
    got = imagery.regrid(pixels, ["tile_id"], (0.0, 2.0, 1.0), (0.0, 0.0, 2.0, 2.0), 1.0, "bilinear", -9.0).collect()
    assert len(got) == 8 and {r["v"] for r in got} == {-9.0}
