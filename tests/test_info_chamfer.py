"""The contrastive Chamfer distance reads its neighbours once, and loses no term of its sums."""

import math
import random

from tileloom.operators import metrics


def test_neighbours_are_read_once_and_far_terms_count(spark):
    rnd, tau = random.Random(1), 0.3
    far = {"near": 0.0, "far": 500.0, "edge": 512 * tau * 3 - 1.0}
    rows = [
        (t, side, 0.0, 0.0, 0.0, base + rnd.uniform(0, 2) * (400 if i % 7 == 0 else 1), 0.0, 0.0)
        for t, base in far.items() for side, n in (("ab", 9), ("ba", 14)) for i in range(n)
    ]
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    names = "tile_id string, side string, x double, y double, z double, n_x double, n_y double, n_z double"
    nn = spark.createDataFrame(rows, names).mapInPandas(counted, names)
    got = {r["tile_id"]: r["infocd"] for r in metrics.info_chamfer(nn, tau).collect()}
    assert reads.value == len(rows)
    for t in far:
        total = 0.0
        for side in ("ab", "ba"):
            d = [r[5] for r in rows if r[0] == t and r[1] == side]
            least = min(d)
            lse = math.log(sum(math.exp((least - v) / tau) for v in d)) - least / tau
            total += sum(d) / (tau * len(d)) + 3.0 / 14 * lse
        assert abs(got[t] - total) < 1e-9 * abs(total)
