"""Hand-computed edge rules."""

import math

import pytest
from pyspark.sql import functions as F

from tileloom.functions import values
from tileloom.operators import augment, canopy, grid, imagery, metrics, neighbors, normalize, quality, ranks, spatial, stats, voxel



def box10():
    return grid.fixed_box(0, 0, 10, 10)


def pts(spark, rows, cloud="uav"):
    data = [("t", cloud, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rows)]
    return spark.createDataFrame(data, "tile_id string, cloud string, pid long, x double, y double, z double")


def test_truncate_against_floor(spark):
    p = pts(spark, [(-0.3, 0.5, 1)])
    assert grid.max_surface(p, box10(), 1.0).count() == 0
    assert grid.coverage(p, box10(), 1.0, 1, 1.0).first()["covered_cells"] == 1


def test_upper_edge(spark):
    p = pts(spark, [(10, 5, 1)])
    assert grid.cell_aggregate(p, box10(), 1.0, F.max).first()["col"] == 9
    assert grid.min_surface(p, box10(), 1.0).count() == 0


def test_coverage_share_and_thin_box(spark):
    rows = [(i % 10 + 0.5, i // 10 + 0.5, 1) for i in range(96) for _ in range(5)]
    got = grid.coverage(pts(spark, rows), box10(), 1.0, 5, 96.0).first()
    assert got["coverage_pct"] == pytest.approx(96.0) and got["is_complete"]
    thin = grid.coverage(pts(spark, rows), grid.fixed_box(0, 0, 1, 10), 1.0, 1, 0.0).first()
    assert not thin["is_complete"] and thin["total_cells"] == 0


def test_mad_rules(spark):
    flat = pts(spark, [(0.5, 0.5, z) for z in (5, 5, 5, 9)])
    assert grid.cell_aggregate_clean(flat, box10(), 1.0, F.max).first()["v"] == 9
    wild = pts(spark, [(0.5, 0.5, z) for z in (1, 2, 3, 4, 100)])
    assert grid.cell_aggregate_clean(wild, box10(), 1.0, F.max).first()["v"] == 4


def test_percentiles_both_paths(spark):
    rows = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 10.0)] + [("b", float(v % 7)) for v in range(50)], "g string, v double")
    usual = {r["g"]: r["q"] for r in ranks.percentiles(rows, ["g"], "v", [0.5, 0.95]).collect()}
    hot = {r["g"]: r["q"] for r in ranks.percentiles(rows, ["g"], "v", [0.5, 0.95], hot_rows=2).collect()}
    assert usual["a"][1] == pytest.approx(9.2)
    for g in usual:
        assert hot[g] == pytest.approx(usual[g])


def test_average_rank_with_small_buckets(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in (10, 20, 20, 30)], "g int, v double")
    got = {r["v"]: r["rank"] for r in ranks.average_ranks(rows, ["g"], "v").collect()}
    assert got == {10.0: 1.0, 20.0: 2.5, 30.0: 4.0}
    many = spark.range(500).select(F.lit(0).alias("g"), (F.pow(F.col("id") % 97, 3) - 5000).alias("v"))
    hist = ranks.cumulative_histogram(many, ["g"], "v", rows_per_bucket=5).orderBy("v").collect()
    below = 0
    for row in hist:
        assert row["start"] == below
        below += row["c"]
    assert below == 500


def test_lowest_n_is_exact(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("pid"))
    from tileloom.functions.draws import uniform

    u = uniform("1", F.col("pid"))
    got = ranks.lowest_n(rows, ["g"], u, lambda n: n / 2, ["pid"], buckets=4)
    want = rows.withColumn("u", u).toPandas()
    for g, part in want.groupby("g"):
        best = set(part.nsmallest(len(part) // 2, "u")["pid"])
        assert best == {r["pid"] for r in got.where(F.col("g") == g).collect()}


def test_event_gap_and_slots(spark):
    rows = [("t", f"i{k}", f"2024-01-0{d}") for k, d in enumerate((1, 2, 3, 5))]
    im = spark.createDataFrame(rows, "tile_id string, image_id string, dt string").withColumn("dt", F.to_date("dt"))
    events = imagery.acquisition_events(im, ["tile_id"])
    assert sorted(r["event_ix"] for r in events.collect()) == [0, 0, 0, 1]
    assert imagery.event_slots(events, ["tile_id"]).count() == 3
    ten = spark.range(10).select(F.lit("t").alias("tile_id"), F.col("id").cast("string").alias("image_id"), F.to_date(F.lit("2024-01-01")).alias("dt"))
    slots = imagery.event_slots(imagery.acquisition_events(ten, ["tile_id"]), ["tile_id"])
    assert slots.count() == 8
    assert imagery.attention_masks(slots, ["tile_id"]).first()["attention_mask"] == [True] * 8


def test_value_statistics(spark):
    rows = spark.createDataFrame([("b", v) for v in (1.0, math.nan, math.inf, 3.0)] + [("f", 4.0)] * 3, "band string, v double")
    got = {r["band"]: r for r in normalize.value_statistics(rows, ["band"]).collect()}
    assert (got["b"]["mean"], got["b"]["std"], got["b"]["n"], got["b"]["n_nan"], got["b"]["n_inf"]) == (2.0, 1.0, 2, 1, 1)
    assert got["f"]["std"] == 1.0


def test_voxel_tie_and_cap(spark):
    p = pts(spark, [(0.0, 0.0, 0.0), (0.2, 0.0, 0.0)])
    assert voxel.voxel_downsample(p, 1.0).first()["pid"] == 0
    small = voxel.adaptive_sizes(p, 5, 4.0, 0.5).first()
    assert small["whole"] and small["size_cm"] == 4.0
    grid_points = pts(spark, [(x / 5, y / 5, 0) for x in range(20) for y in range(20)])
    kept = voxel.adaptive_downsample(grid_points, 60, 4.0, 0.5)
    assert 0 < kept.count() <= 60
    assert kept.join(grid_points, kept.columns, "left_anti").count() == 0


def test_boxes_touch(spark):
    a = spark.createDataFrame([("a", 0.0, 0.0, 5.0, 5.0)], "ia string, xmin double, ymin double, xmax double, ymax double")
    b = spark.createDataFrame([("b", 5.0, 5.0, 9.0, 9.0)], "ib string, bx0 double, by0 double, bx1 double, by1 double")
    assert spatial.join_boxes(a, b, 2.0, right_box=("bx0", "by0", "bx1", "by1")).count() == 1


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "tile_id string, ordinal int")
    kept = quality.first_of_duplicates(rows, ["ordinal"])
    assert sorted(r["ordinal"] for r in kept.collect()) == [1, 3, 4]
    assert quality.duplicate_counts(rows).first()["n_extra"] == 1


@pytest.mark.parametrize("high,kept", [(21, 0), (20, 80)])
def test_height_cap(spark, high, kept):
    p = pts(spark, [(0, 0, 99.0)] * high + [(0, 0, 1.0)] * (100 - high))
    assert quality.cap_height(p).count() == kept


def clouds(spark, a, b):
    return pts(spark, a, "a").unionByName(pts(spark, b, "b"))


def test_single_pair_distances(spark):
    nn = neighbors.both_ways(clouds(spark, [(0, 0, 0)], [(3, 4, 0)]), "a", "b")
    assert metrics.chamfer_squared(nn).first()["chamfer_distance"] == 50
    assert metrics.chamfer_euclidean(nn).first()["chamfer_l2"] == 10
    assert metrics.hausdorff(nn).first()["hausdorff"] == 5


def test_trim(spark):
    nn = spark.range(100).select(F.lit("t").alias("tile_id"), F.lit("ba").alias("side"), F.col("id").cast("double").alias("d2"))
    got = metrics.trimmed_chamfer(nn).first()
    assert got["kept"] == 99 and got["v"] == pytest.approx(sum(range(99)) / 99)


def test_density_aware_of_equal_points(spark):
    nn = neighbors.both_ways(clouds(spark, [(1, 1, 1)], [(1, 1, 1)]), "a", "b")
    counts = spark.createDataFrame([("t", 1, 1), ("e", 0, 3)], "tile_id string, n_a long, n_b long")
    got = {r["tile_id"]: r["dcd"] for r in metrics.density_aware(nn, counts).collect()}
    assert got["t"] == pytest.approx(0, abs=1e-5) and got["e"] == 0.5


def test_neighbours_with_coincident_points(spark):
    """A third of the points on one spot, far outliers, every depth of the tree."""
    import numpy as np

    rng = np.random.default_rng(3)
    a = np.vstack([rng.normal(size=(150, 3)), np.tile([[0.5, 0.5, 0.5]], (100, 1)), [[50, 50, 50]]])
    b = np.vstack([rng.normal(size=(200, 3)), np.tile([[0.5, 0.5, 0.4]], (100, 1)), [[-90, 0, 0]]])
    nn = neighbors.both_ways(clouds(spark, a.tolist(), b.tolist()), "a", "b", leaf=4).toPandas()
    d = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    got = nn[nn.side == "ab"].sort_values("pid")["d2"].to_numpy()
    assert np.allclose(got, d.min(1)) and len(nn) == len(a) + len(b)
    graph = neighbors.nearest(pts(spark, a.tolist()), pts(spark, a.tolist()), k=5, exclude_self=True, leaf=4).toPandas()
    own = ((a[:, None, :] - a[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(own, np.inf)
    want = np.sort(own, axis=1)[:, :5]
    found = graph.sort_values(["pid", "rank"])["d2"].to_numpy().reshape(-1, 5)
    assert np.allclose(found, want)


def test_layer_diversity(spark):
    cells = pts(spark, [(0.5, 0.5, 1), (0.5, 0.5, 3)]).withColumn("hag", F.col("z")).withColumn("row", F.lit(0)).withColumn("col", F.lit(0))
    p = canopy.layer_proportions(cells, 0.0, 4.0, 2)
    assert canopy.layer_diversity(p).first()["fhd"] == pytest.approx(math.log(2))


def test_turns(spark):
    p = pts(spark, [(1, 0, 0)])
    once = augment.rotate_points(p, F.lit(90)).first()
    assert (once["x"], once["y"]) == (0.0, -1.0)
    back = p
    for _ in range(4):
        back = augment.rotate_points(back, F.lit(90))
    assert back.collect() == p.collect()
    px = spark.createDataFrame([(0, 1)], "row int, col int")
    for _ in range(4):
        px = augment.rotate_pixels(px, F.lit(270), F.lit(3), F.lit(3))
    assert px.first() == (0, 1)


def test_sign_effect(spark):
    d = spark.createDataFrame([("p", 2.0, v) for v in (1.0, 1.0, -1.0, 0.0)], "pair string, base double, d double")
    assert stats.paired(d).first()["sign_effect"] == 0.25


def test_p_values():
    assert stats.t_p_value(0.5, 20) == pytest.approx(0.0247, abs=2e-4)
    assert stats.t_p_value(0.0, 20) == pytest.approx(1.0)


def test_normal_tail(spark):
    z = spark.createDataFrame([(1.959964,), (0.0,)], "z double").select(stats.two_sided(F.col("z")).alias("p")).collect()
    assert z[0]["p"] == pytest.approx(0.05, abs=1e-6) and z[1]["p"] == pytest.approx(1.0, abs=1e-6)


def test_tiling(spark):
    area = spark.createDataFrame([("a", 0.0, 0.0, 30.0, 30.0)], "area_id string, xmin double, ymin double, xmax double, ymax double")
    tiles = spatial.tile_boxes(area, 10, 10, 0.15)
    assert tiles.count() == 9
    assert sorted({r["xmin"] for r in tiles.collect()}) == [0.0, 8.5, 17.0]
    with pytest.raises(ValueError):
        spatial.tile_boxes(area, 10, 10, 1.0)


def test_empty_range(spark):
    assert spark.range(1).select(values.rescale(F.lit(3.0), 2, 2).alias("v")).first()["v"] == 0.1


def test_capped_copies(spark):
    w = spark.createDataFrame([("a", 0.7), ("b", 0.1), ("c", 0.1), ("d", 0.1)], "tile_id string, p double")
    got = augment.weighted_copies(w, 10, "1", cap=4).groupBy("tile_id").count().collect()
    n = {r["tile_id"]: r["count"] for r in got}
    assert n["a"] == 4 and sum(n.values()) == 10


def test_speckle(spark):
    px = spark.range(4000).select(F.lit("t").alias("tile_id"), F.lit("i").alias("image_id"), F.lit("b").alias("band"), F.col("id").alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("v"))
    row = augment.radar_speckle(px, "1").agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
    assert row["m"] == pytest.approx(1.0, abs=0.02) and row["s"] == pytest.approx(math.sqrt(0.1), abs=0.02)


def test_hull(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    inner = rng.uniform(1, 9, size=(300, 2)).tolist()
    p = pts(spark, [(x, y, 0) for x, y in inner + [[0, 0], [10, 0], [10, 10], [0, 10]]])
    got = grid.convex_hull(p, rows_per_strip=20).orderBy("ix").collect()
    assert [(r["x"], r["y"]) for r in got] == [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_lowest_parabolas_equal_all_candidates():
    import random

    rnd = random.Random(1)
    for _ in range(3000):
        n, rows = rnd.randint(1, 14), rnd.randint(1, 12)
        row = rnd.randrange(rows)
        source = [float("nan") if rnd.random() < 0.4 else float(rnd.randrange(rows)) for _ in range(n)]
        known = [(s, c) for c, s in enumerate(source) if s == s]
        want = [min(((s - row) ** 2 + (x - c) ** 2, s, c) for s, c in known)[2] if known else None for x in range(n)]
        assert grid.lowest_parabolas(source, row, n) == want
