"""The evaluation frame writes sums, not points: a tile's points travel once for all models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileloom.operators import metrics, neighbors
from tileloom.plans import evaluation

MODELS = ["m1", "m2", "m3"]


def clouds(spark):
    rng = np.random.default_rng(5)
    sizes = {"a": (40, 60, 0, 90), "b": (30, 0, 20, 80), "c": (20, 20, 20, 0), "d'\"": (200, 10, 3, 150)}
    rows = [
        (t, c, i, *map(float, rng.integers(0, 9, 3) + 0.5 * (c == "m2")))
        for t, n in sizes.items() for c, k in zip((*MODELS, "truth"), n) for i in range(k)
    ]
    return spark.createDataFrame(rows + rows[:15], "tile_id string, cloud string, pid long, x double, y double, z double")


@pytest.mark.parametrize("leaf", [neighbors.LEAF, 4])
def test_several_clouds_at_once_are_as_each_alone(spark, leaf):
    want = ["pid", "n_pid", "d2", "d1", "n_shared"]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    together = neighbors.both_ways(clouds(spark), MODELS, "truth", leaf=leaf, want=want)
    assert together.columns == ["tile_id", "cloud", "side", *want]
    for m in MODELS:
        alone = neighbors.both_ways(clouds(spark), m, "truth", leaf=leaf, want=want)
        assert rows(together.where(F.col("cloud") == m).drop("cloud")) == rows(alone)


def test_only_sums_are_written(spark, monkeypatch):
    points, sizes = clouds(spark).localCheckpoint(), []

    def counting(write):
        def run(df):
            out = write(df)
            sizes.append(out.count())
            return out

        return run

    for module in (neighbors, evaluation):
        for name in ("cut_lineage", "written"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, counting(getattr(module, name)))
    found = {(r.tile_id, r.model, r.metric): r.v for r in evaluation.model_distances(points, "truth", MODELS).collect()}
    assert sum(sizes) < points.count()
    want = {}
    for m in MODELS:
        nn = neighbors.both_ways(points, m, "truth").cache()
        counts = nn.groupBy("tile_id").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(n) for s, n in (("ab", "n_a"), ("ba", "n_b"))])
        for metric, df in (("chamfer_distance", metrics.chamfer_squared(nn)), ("dcd", metrics.density_aware(nn, counts)),
                           ("infocd", metrics.info_chamfer(nn)), ("point_count", counts.select("tile_id", "n_a"))):
            want |= {(t, m, metric): float(v) for t, v in df.collect()}
    assert found == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(found) == 7 * 4
