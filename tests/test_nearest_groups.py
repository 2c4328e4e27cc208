"""Nearest neighbours in groups of few and of many points, against all pairs."""

import numpy as np
import pytest

from tileloom.operators import neighbors


def cloud(spark, sizes, seed, text_ids=False):
    rng = np.random.default_rng(seed)
    rows, pid = [], 0
    for tile, n in sizes.items():
        # A lattice, so that many distances are equal and some spots hold several points.
        for x, y, z in rng.integers(0, 7, (n, 3)).astype(float).tolist():
            rows.append((tile, f"p{pid:05d}" if text_ids else pid, x, y, z))
            pid += 1
    kind = "string" if text_ids else "long"
    return spark.createDataFrame(rows, f"tile_id string, pid {kind}, x double, y double, z double"), rows


def brute(a, b, k, exclude_self):
    out = set()
    for tile, pid, *p in a:
        ways = sorted(
            (sum((u - v) ** 2 for u, v in zip(p, q)), *q, other) for t, other, *q in b
            if t == tile and not (exclude_self and other == pid and q == p)
        )
        out |= {(tile, pid, rank + 1, way[0], way[4]) for rank, way in enumerate(ways[:k])}
    return out


@pytest.mark.parametrize("k, exclude_self, text_ids", [(1, False, False), (4, True, False), (40, True, True), (1, True, True)])
def test_small_and_large_groups_equal_all_pairs(spark, k, exclude_self, text_ids):
    queries, qs = cloud(spark, {"few": 30, "many": 150, "alone": 5}, 1, text_ids)
    targets, ts = (queries, qs) if exclude_self else cloud(spark, {"few": 45, "many": 140, "empty": 9}, 2, text_ids)
    found = neighbors.nearest(queries, targets, k=k, exclude_self=exclude_self, leaf=3).collect()
    got = [(r["tile_id"], r["pid"], r["rank"] if k > 1 else 1, r["d2"], r["n_pid"]) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute(qs, ts, k, exclude_self)


def test_groups_of_few_points_are_compared_without_a_tree(spark):
    points, _ = cloud(spark, {f"t{i}": 20 for i in range(6)}, 3)
    plan = neighbors.nearest(points, points, k=2, exclude_self=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInArrow" in plan and "transform(" not in plan


def test_equal_rows_and_rows_without_coordinates(spark):
    points = spark.createDataFrame(
        [("t", 1, 0.0, 0.0, 0.0), ("t", 1, 0.0, 0.0, 0.0), ("t", 2, 3.0, 4.0, 0.0), ("t", 3, None, 0.0, 0.0), (None, 4, 0.0, 0.0, 0.0)],
        "tile_id string, pid long, x double, y double, z double",
    )
    got = {(r["pid"], r["n_pid"], r["d2"]) for r in neighbors.nearest(points, points, exclude_self=True).collect()}
    assert got == {(1, 2, 25.0), (2, 1, 25.0)}


def test_many_small_groups_share_a_call(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    numbers = neighbors._numbers
    monkeypatch.setattr(neighbors, "_numbers", lambda *pids: calls.add(1) or numbers(*pids))
    queries, qs = cloud(spark, {f"t{i}": 6 for i in range(60)}, 4)
    targets, ts = cloud(spark, {f"t{i}": 5 for i in range(55)}, 5)
    found = neighbors.nearest(queries, targets).collect()
    assert {(r["tile_id"], r["pid"], 1, r["d2"], r["n_pid"]) for r in found} == brute(qs, ts, 1, False)
    assert len(found) == 55 * 6 and calls.value <= 4
