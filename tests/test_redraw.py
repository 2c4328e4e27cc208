"""Augmented tiles with a way back: originals kept, copies drawn again."""

import pytest
from pyspark.sql import functions as F

from tileloom.operators import augment, redraw
from tileloom.operators.neighbors import edge_table
from tileloom.operators.quality import augmentation_violations


def cloud(spark, sizes):
    rows = [(t, i, float(i % 13), float(i % 7), float(i % 5) + i / 1000) for t, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "tile_id string, pid long, x double, y double, z double")


def weights(spark, **p):
    return spark.createDataFrame(list(p.items()), "tile_id string, p double")


def copied(copies):
    """One point per copy; the judge below reads its attempt."""
    return copies.select(F.col("new_id").alias("tile_id"), "attempt")


def failing(*tiles, upto=10**6):
    name = F.regexp_extract("tile_id", r"^(.*)_aug_", 1)
    return lambda made: made.where(name.isin(*tiles) & (F.col("attempt") < upto)).select("tile_id", F.lit("bad").alias("violation"))


def outcome(found):
    return {r.tile_id: (r.accepted, r.spare, r.rejected, r.status) for r in found.report.collect()}


def test_total_is_met_and_equal_on_reruns(spark):
    w = weights(spark, a=1.0, b=2.0, c=3.0)
    twice = [redraw.redrawn_copies(w, 12, "7", copied, failing("a", upto=2), attempts=20) for _ in range(2)]
    first, second = (sorted(map(tuple, f.copies.collect())) for f in twice)
    assert first == second and len(first) == 12
    assert len({r[2] for r in first}) == 12
    assert {r.tile_id for r in twice[0].points.collect()} == {r[2] for r in first}
    assert all(r[1] >= 2 for r in first if r[0] == "a")


def test_a_tile_that_always_fails_is_exhausted(spark):
    found = redraw.redrawn_copies(weights(spark, a=8.0, b=1.0, c=1.0), 9, "7", copied, failing("a"), cap=5, attempts=6)
    got = outcome(found)
    assert got["a"] == (0, 0, 6, "exhausted")
    assert got["b"][0] + got["c"][0] == 9 and max(got["b"][0], got["c"][0]) <= 5


def test_too_few_copies_are_reported(spark):
    found = redraw.redrawn_copies(weights(spark, a=1.0, b=1.0), 50, "7", copied, failing("a"), cap=3, attempts=4)
    assert outcome(found) == {"a": (0, 0, 4, "exhausted"), "b": (3, 0, 0, "full")}
    assert found.copies.count() == 3
    none = redraw.redrawn_copies(weights(spark, a=1.0), 5, "7", copied, failing("a"), attempts=4)
    assert none.copies.count() == 0 and outcome(none) == {"a": (0, 0, 4, "exhausted")}


def test_tiles_without_weight_and_without_rows(spark):
    found = redraw.redrawn_copies(weights(spark, a=0.0, b=1.0, c=None), 4, "7", copied, failing("x"))
    assert outcome(found) == {"a": (0, 0, 0, "open"), "b": (4, 0, 0, "open"), "c": (0, 0, 0, "open")}
    empty = redraw.redrawn_copies(weights(spark, a=1.0).limit(0), 4, "7", copied, failing("x"))
    assert empty.copies.count() == 0 and empty.points.count() == 0 and empty.report.count() == 0
    assert redraw.redrawn_copies(weights(spark, a=1.0), 0, "7", copied, failing("x")).copies.count() == 0


def test_copies_that_lose_all_points_are_drawn_again(spark):
    vanish = lambda ids: copied(ids).where("attempt >= 3")
    found = redraw.redrawn_copies(weights(spark, a=1.0), 2, "7", vanish, failing("x"))
    assert outcome(found)["a"][::2] == (2, 3) and found.copies.where("attempt < 3").count() == 0


@pytest.mark.parametrize("least", [0, 150, 10**6])
def test_kept_versions(spark, least):
    points = cloud(spark, {"a": 120, "b": 300})
    draws = augment.step_draws(points, "5", {"remove_points": 100.0, "mask_points": 0.0, "remove_slice": 0.0, "add_points": 0.0})
    few = lambda made: augmentation_violations(made.withColumn("cloud", F.lit("dep")), None, "dep", least, 1e9, ("x",))
    kept = redraw.augment_or_keep(points, "5", draws, few)
    n = {r.tile_id: r["count"] for r in kept.points.groupBy("tile_id").count().collect()}
    good = {r.tile_id: r.augmented for r in kept.outcome.collect()}
    assert good == {"a": least <= 108, "b": least <= 270}
    assert n == {"a": 108 if good["a"] else 120, "b": 270 if good["b"] else 300}
    rolled = kept.points.join(kept.outcome.where("not augmented"), "tile_id", "left_semi")
    assert rolled.exceptAll(points.join(kept.outcome.where("not augmented"), "tile_id", "left_semi")).count() == 0


def test_stored_graph_of_unchanged_tiles(spark):
    points = cloud(spark, {"a": 30, "b": 40})
    off = {s: 0.0 for s in augment.STEPS}
    draws = augment.step_draws(points, "5", off).withColumn("do_rotate", F.col("tile_id") == "b")
    kept = redraw.augment_or_keep(points, "5", draws, lambda made: made.select("tile_id", F.lit("x").alias("violation")).limit(0))
    marked = edge_table(points, 2).where("tile_id = 'a'").limit(3)
    graph = redraw.regraph(kept, marked, 2)
    assert graph.where("tile_id = 'a'").count() == 3
    fresh = edge_table(kept.points.where("tile_id = 'b'"), 2)
    assert sorted(map(tuple, graph.where("tile_id = 'b'").collect())) == sorted(map(tuple, fresh.collect()))
