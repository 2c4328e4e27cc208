"""Distances between clouds as aggregates over one nearest-neighbour table.

``nn`` is the table of :func:`tileloom.operators.neighbors.both_ways`: one row per
point of either cloud, with ``side`` 'ab' or 'ba' and the squared distance ``d2``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tileloom.operators.ranks import cumulative_histogram

SIDE = ["tile_id", "side"]
#: Exponents in this range of each other are summed as they are (the least term is about 1e-223).
STEP = 512.0


def _two_sides(per_side: DataFrame, value: str, combine: Callable[[Column, Column], Column], out: str):
    ab = F.max(F.when(F.col("side") == "ab", F.col(value)))
    ba = F.max(F.when(F.col("side") == "ba", F.col(value)))
    wide = per_side.groupBy("tile_id").agg(ab.alias("_ab"), ba.alias("_ba"))
    return wide.select("tile_id", combine(F.col("_ab"), F.col("_ba")).alias(out))


def _soft(alpha: float, eps: float) -> Column:
    return F.exp(-F.lit(alpha) * F.sqrt(F.greatest(F.col("d2"), F.lit(eps))))


def _stepped(nn: DataFrame, tau: float) -> DataFrame:
    """``nn`` with the Manhattan distance as ``d``, the exponent ``_x`` and the step ``_s`` it lies in."""
    d = F.col("d1") if "d1" in nn.columns else _manhattan()
    rows = nn.withColumn("d", d).withColumn("_x", F.col("d") / F.lit(float(tau)))
    return rows.withColumn("_s", F.floor(F.col("_x") / F.lit(STEP)))


def _shifted_term() -> Column:
    return F.exp(F.col("_s") * F.lit(STEP) - F.col("_x"))


def _of(name: str, *options: float) -> str:
    """The sum's column, which tells the options it was made with."""
    return "_".join([name, *[repr(float(o)).replace(".", "p") for o in options]])


def match_sums(
    nn: DataFrame, group: list[str] = SIDE, alpha: float = 1.0, eps: float = 1e-12, tau: float = 0.3
) -> DataFrame:
    """What M1, M5 and M6 sum over the points, in one pass: a row per group, ``n_shared`` and step of the exponent.

    :func:`chamfer_squared`, :func:`density_aware` and :func:`info_chamfer` take this small table in place of
    the points' rows, with the same ``alpha``, ``eps`` and ``tau``. ``nn`` has ``n_shared``.
    """
    return _stepped(nn, tau).groupBy(*group, "n_shared", "_s").agg(
        F.count(F.lit(1)).alias("_points"), F.sum("d2").alias("_d2"), F.sum(_soft(alpha, eps)).alias(_of("_soft", alpha, eps)),
        F.sum("d").alias("_d"), F.sum(_shifted_term()).alias(_of("_term", tau)),
    )


def side_counts(nn: DataFrame) -> DataFrame:
    """The points of either cloud of a tile, n_a and n_b, told by their rows or sums."""
    points = (lambda s: F.sum(F.when(F.col("side") == s, F.col("_points")).otherwise(0))) if "_points" in nn.columns else (
        lambda s: F.count(F.when(F.col("side") == s, 1)))
    return nn.groupBy("tile_id").agg(points("ab").alias("n_a"), points("ba").alias("n_b"))


def one_sided(nn: DataFrame) -> DataFrame:
    """K4: mean squared nearest distance per side."""
    mean = F.sum("_d2") / F.sum("_points") if "_points" in nn.columns else F.avg("d2")
    return nn.groupBy(*SIDE).agg(mean.alias("mean_d2"))


def chamfer_squared(nn: DataFrame, out: str = "chamfer_distance") -> DataFrame:
    """M1: mean squared nearest distance, both sides added."""
    return _two_sides(one_sided(nn), "mean_d2", lambda p, q: p + q, out)


def chamfer_euclidean(nn: DataFrame, out: str = "chamfer_l2") -> DataFrame:
    """M2."""
    sides = nn.groupBy(*SIDE).agg(F.avg(F.sqrt("d2")).alias("v"))
    return _two_sides(sides, "v", lambda p, q: p + q, out)


def hausdorff(nn: DataFrame, out: str = "hausdorff") -> DataFrame:
    """M4."""
    sides = nn.groupBy(*SIDE).agg(F.sqrt(F.max("d2")).alias("v"))
    return _two_sides(sides, "v", F.greatest, out)


def _manhattan() -> Column:
    return sum((F.abs(F.col(c) - F.col(f"n_{c}")) for c in ("y", "z")), F.abs(F.col("x") - F.col("n_x")))


def _point_distance(norm: str, delta: float, eps: float) -> Column:
    l2 = F.sqrt(F.col("d2") + F.lit(eps))
    if norm == "L1":
        return _manhattan()
    if norm == "L2":
        return l2
    if norm == "L2_squared":
        return F.col("d2")
    if norm == "Huber":
        return F.when(l2 <= delta, l2 * l2 * 0.5).otherwise(delta * (l2 - 0.5 * delta))
    raise ValueError("norm must be L1, L2, L2_squared or Huber")


def trimmed_chamfer(
    nn: DataFrame, norm: str = "L2_squared", trim_ab: float = 0.0, trim_ba: float = 0.01,
    reduction: str = "mean", delta: float = 2.0, eps: float = 1e-8,
) -> DataFrame:
    """M3 per tile and side: sum of the smallest ceil((1 - t) * n) distances and their number.

    The cut is found on the cumulative histogram of distances, so no side of a tile
    is sorted in one task. ``reduction`` 'mean' divides each side by its kept number.
    """
    if not (0.0 <= trim_ab < 1.0 and 0.0 <= trim_ba < 1.0):
        raise ValueError("trim shares must be in [0, 1)")
    if reduction not in ("mean", "sum"):
        raise ValueError("reduction must be 'mean' or 'sum'")
    rows = nn.select(*SIDE, _point_distance(norm, delta, eps).alias("d"))
    if trim_ab == 0.0 and trim_ba == 0.0:
        kept = rows.groupBy(*SIDE).agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("kept"))
    else:
        hist = cumulative_histogram(rows, SIDE, "d")
        total = hist.groupBy(*SIDE).agg(F.sum("c").alias("_n"))
        share = F.when(F.col("side") == "ab", F.lit(1.0 - trim_ab)).otherwise(F.lit(1.0 - trim_ba))
        want = F.greatest(F.ceil(share * F.col("_n")), F.lit(1))
        taken = F.greatest(F.least(F.col("c"), F.col("_want") - F.col("start")), F.lit(0))
        kept = hist.join(total.withColumn("_want", want), SIDE).groupBy(*SIDE).agg(
            F.sum(F.col("d") * taken).alias("s"), F.max("_want").alias("kept")
        )
    value = F.col("s") / F.col("kept") if reduction == "mean" else F.col("s")
    return kept.select(*SIDE, value.alias("v"), "s", "kept")


def general_chamfer(nn: DataFrame, weights: DataFrame | None = None, batch: str | None = "mean", **options):
    """M3: one value per tile (``batch=None``) or one for all tiles.

    ``weights`` has tile_id and w. A 'mean' over tiles divides point means by the
    number of tiles (or the weights' sum) and point sums by the points kept.
    """
    if batch not in (None, "mean", "sum"):
        raise ValueError("batch must be None, 'mean' or 'sum'")
    sides = trimmed_chamfer(nn, **options)
    one = F.lit(1.0)
    sides = sides.withColumn("w", one) if weights is None else sides.join(weights, "tile_id")
    weighted = sides.withColumn("v", F.col("v") * F.col("w"))
    if batch is None:
        return _two_sides(weighted, "v", lambda p, q: p + q, "chamfer")
    if batch == "sum":
        return weighted.agg(F.sum("v").alias("chamfer"))
    by_points = options.get("reduction", "mean") == "sum"
    size = F.sum(F.col("w") * F.col("kept")) if by_points else F.sum("w")
    total = weighted.groupBy("side").agg((F.sum("v") / F.greatest(size, F.lit(1e-8))).alias("v"))
    return total.agg(F.sum("v").alias("chamfer"))


def normals_distance(nn: DataFrame, normals: DataFrame | None = None, eps: float = 1e-8) -> DataFrame:
    """M3's normals part: mean of 1 - |cos| between a point's and its neighbour's normal, sides added.

    ``normals`` has tile_id, pid and nx, ny, nz, one row per (tile_id, pid). Without it ``nn`` carries them:
    nx, ny, nz of the point and n_nx, n_ny, n_nz of its neighbour.
    """
    if normals is None:
        return _normals(nn.select(*SIDE, *[F.col(f"n{c}").alias(f"_a{c}") for c in "xyz"], *[F.col(f"n_n{c}").alias(f"_b{c}") for c in "xyz"]), eps)
    own = normals.select("tile_id", "pid", *[F.col(f"n{c}").alias(f"_a{c}") for c in "xyz"])
    other = normals.select("tile_id", F.col("pid").alias("n_pid"), *[F.col(f"n{c}").alias(f"_b{c}") for c in "xyz"])
    return _normals(nn.join(own, ["tile_id", "pid"]).join(other, ["tile_id", "n_pid"]), eps)


def _normals(both: DataFrame, eps: float) -> DataFrame:
    dot = sum((F.col(f"_a{c}") * F.col(f"_b{c}") for c in "yz"), F.col("_ax") * F.col("_bx"))
    size = lambda t: F.sqrt(sum((F.pow(F.col(f"_{t}{c}"), 2) for c in "yz"), F.pow(F.col(f"_{t}x"), 2)))
    cosine = dot / (F.greatest(size("a"), F.lit(eps)) * F.greatest(size("b"), F.lit(eps)))
    sides = both.groupBy(*SIDE).agg(F.avg(F.lit(1.0) - F.abs(cosine)).alias("v"))
    return _two_sides(sides, "v", lambda p, q: p + q, "normals")


def density_aware(
    nn: DataFrame, counts: DataFrame, alpha: float = 1.0, n_lambda: float = 1.0, eps: float = 1e-12
) -> DataFrame:
    """M5: nearest distances discounted where many points share one match.

    ``counts`` has tile_id, n_a and n_b (0 for an empty cloud). A side whose own
    cloud is empty while the other is not costs 1; with both empty it is 0. Where ``nn`` has ``n_shared``
    (see :func:`tileloom.operators.neighbors.both_ways`), no match is counted again.
    """
    soft = F.col(_of("_soft", alpha, eps)) if "_points" in nn.columns else _soft(alpha, eps)
    if "n_shared" in nn.columns:
        # All points of a side whose matches are shared by as many have one factor.
        groups = nn.groupBy(*SIDE, F.col("n_shared").alias("_q")).agg(F.sum(soft).alias("_e"))
    else:
        # All points with the same match share its count, so one row per match is enough.
        match = ["tile_id", "side", "n_pid", "n_x", "n_y", "n_z"]
        groups = nn.groupBy(*match).agg(F.count(F.lit(1)).alias("_q"), F.sum(soft).alias("_e"))
    joined = groups.join(counts, "tile_id")
    own = F.when(F.col("side") == "ab", F.col("n_a")).otherwise(F.col("n_b")).cast("double")
    other = F.when(F.col("side") == "ab", F.col("n_b")).otherwise(F.col("n_a")).cast("double")
    load = F.pow(F.col("_q").cast("double"), F.lit(float(n_lambda)))
    factor = F.lit(1.0) / (F.greatest(own / other / (load + eps), F.lit(1.0)) + eps)
    per_side = joined.groupBy("tile_id").agg(
        *[
            F.sum(F.when(F.col("side") == s, F.col("_e") * factor)).alias(f"_{s}")
            for s in ("ab", "ba")
        ]
    )
    sides = counts.join(per_side, "tile_id", "left")

    def loss(s, n_own, n_other):
        full = (F.col(n_own) > 0) & (F.col(n_other) > 0)
        mean = F.lit(1.0) - F.try_divide(F.col(f"_{s}"), F.col(n_own))
        lonely = (F.col(n_own) == 0) & (F.col(n_other) > 0)
        return F.when(full, mean).when(lonely, F.lit(1.0)).otherwise(F.lit(0.0))

    value = (loss("ab", "n_a", "n_b") + loss("ba", "n_b", "n_a")) * 0.5
    return sides.select("tile_id", value.alias("dcd"))


def info_chamfer(nn: DataFrame, tau: float = 0.3, lam: float | None = None, lam_over: str | None = "b",
                 lam_factor: float = 3.0, eps: float = 1e-8) -> DataFrame:
    """M6: contrastive Chamfer with Manhattan distance to the nearest point.

    The weight of the log-sum-exp term is ``lam``, or ``lam_factor`` over the size of
    the cloud ``lam_over`` for both sides, or (``lam_over=None``) one over the size of
    the other cloud. Exponents are shifted by whole steps of ``STEP`` and summed per step, so that no
    term of the sum is lost and the neighbours are read once.
    """
    if "_points" in nn.columns:
        rows, n, term, d = nn, F.sum("_points"), F.col(_of("_term", tau)), F.col("_d")
    else:
        rows, n, term, d = _stepped(nn, tau), F.count(F.lit(1)), _shifted_term(), F.col("d")
    steps = rows.groupBy(*SIDE, "_s").agg(n.alias("n"), F.sum(d).alias("_d"), F.sum(term).alias("_e"))
    steps = steps.withColumn("_m", F.min("_s").over(Window.partitionBy(*SIDE)))
    sums = steps.groupBy(*SIDE).agg(
        F.sum("n").alias("n"), F.sum("_d").alias("_d"), F.max("_m").alias("_m"),
        F.sum(F.col("_e") * F.exp((F.col("_m") - F.col("_s")) * F.lit(STEP))).alias("_e"),
    )
    lse = F.log("_e") - F.col("_m") * F.lit(STEP)
    sides = sums.select("tile_id", "side", "n", (F.col("_d") / (F.lit(tau) * F.col("n"))).alias("cd"), lse.alias("lse"))
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = sides.groupBy("tile_id").agg(*[
        pick(c, s).alias(f"{c}_{s}") for c in ("n", "cd", "lse") for s in ("ab", "ba")
    ])
    if lam is not None:
        la = lb = F.lit(float(lam))
    elif lam_over is None:
        la, lb = F.lit(1.0) / (F.col("n_ba") + eps), F.lit(1.0) / (F.col("n_ab") + eps)
    else:
        la = lb = F.lit(lam_factor) / F.col("n_ba" if lam_over == "b" else "n_ab")
    value = F.col("cd_ab") + F.col("cd_ba") + la * F.col("lse_ab") + lb * F.col("lse_ba")
    return wide.select("tile_id", value.alias("infocd"))


def improvement_ratio(before: Column, after: Column, guard: str = "infinite", cap: float = 32000.0) -> Column:
    """M7: before / after; an infinite loss counts as ``cap``.

    ``guard='infinite'``: a loss of 0 gives infinity. ``guard='one'``: a NaN loss also
    counts as ``cap``, and the ratio is 1 unless both numbers are positive.
    """
    endless = after == float("inf")
    if guard == "infinite":
        loss = F.when(endless, F.lit(cap)).otherwise(after)
        return F.when(loss > 0, F.try_divide(before, loss)).otherwise(F.lit(float("inf")))
    if guard == "one":
        loss = F.when(endless | F.isnan(after), F.lit(cap)).otherwise(after)
        return F.when((before > 0) & (loss > 0), F.try_divide(before, loss)).otherwise(F.lit(1.0))
    raise ValueError("guard must be 'infinite' or 'one'")
