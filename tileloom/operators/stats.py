"""Statistics over the evaluation table: descriptive, paired, ranks and correlations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tileloom.functions.values import finite_or_null, is_finite
from tileloom.operators.ranks import average_ranks, named_percentiles

MODELS = ("input", "baseline", "naip", "uavsar", "combined")
SUFFIX = "_chamfer_distance"


def long_metrics(table: DataFrame, models: tuple = MODELS, suffix: str = SUFFIX) -> DataFrame:
    """Wide to long, non-finite values as NULL."""
    each = F.array(*[
        F.struct(F.lit(m).alias("model"), finite_or_null(F.col(m + suffix)).alias("v")) for m in models
    ])
    return table.select("tile_id", F.explode(each).alias("_e")).select("tile_id", "_e.model", "_e.v")


def describe(table: DataFrame, models: tuple = MODELS, suffix: str = SUFFIX) -> DataFrame:
    """Mean, median, sample deviation, quartiles, IQR and number per model."""
    rows = long_metrics(table, models, suffix)
    plain = rows.groupBy("model").agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n")
    )
    quart = named_percentiles(rows, ["model"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return plain.join(quart, "model").withColumn("iqr", F.col("q75") - F.col("q25"))


def box_table(table: DataFrame, models: tuple = MODELS, whiskers: tuple = (5, 95), suffix: str = SUFFIX):
    """Quartiles and the chosen whisker percentiles per model."""
    rows = long_metrics(table, models, suffix)
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75, "low": whiskers[0] / 100.0, "high": whiskers[1] / 100.0}
    return named_percentiles(rows, ["model"], "v", names)


def differences(table: DataFrame, pairs: list[tuple[str, str]], suffix: str = SUFFIX) -> DataFrame:
    """Rows (pair, base, d = base - other) where both values are finite."""
    each = F.array(*[
        F.struct(
            F.lit(f"{other}_vs_{base}").alias("pair"),
            finite_or_null(F.col(base + suffix)).alias("base"),
            (finite_or_null(F.col(base + suffix)) - finite_or_null(F.col(other + suffix))).alias("d"),
        )
        for base, other in pairs
    ])
    rows = table.select("tile_id", F.explode(each).alias("_e")).select("tile_id", "_e.*")
    return rows.where(F.col("d").isNotNull())


def paired(diffs: DataFrame) -> DataFrame:
    """Median difference, its share of the base median, and the sign effect."""
    sign = diffs.groupBy("pair").agg(
        ((F.count(F.when(F.col("d") > 0, 1)) - F.count(F.when(F.col("d") < 0, 1))).cast("double")
         / F.count(F.lit(1))).alias("sign_effect"),
        F.count(F.lit(1)).alias("n"),
    )
    middle = named_percentiles(diffs, ["pair"], "d", {"median_change": 0.5})
    base = named_percentiles(diffs, ["pair"], "base", {"_base": 0.5})
    joined = sign.join(middle, "pair").join(base, "pair")
    share = F.lit(100.0) * F.try_divide("median_change", "_base")
    return joined.select("pair", "median_change", share.alias("percent_change"), "sign_effect", "n")


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """Signed-rank statistic without zeros, tie-corrected normal deviate and two-sided p."""
    signed = diffs.where(F.col("d") != 0).select("pair", F.signum("d").alias("_s"), F.abs("d").alias("_a"))
    up = F.when(F.col("_s") > 0, 1).otherwise(0)
    counts = signed.groupBy("pair", "_a").agg(F.sum(up).alias("_up"), F.count(F.lit(1)).alias("_all"))
    ranked = average_ranks(signed, ["pair"], "_a").join(counts, ["pair", "_a"])
    sums = ranked.groupBy("pair").agg(
        F.sum(F.col("rank") * F.col("_up")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("_all") - F.col("_up"))).alias("w_minus"),
        F.sum("_all").alias("n"),
        F.sum(F.pow(F.col("_all").cast("double"), 3) - F.col("_all")).alias("_ties"),
    )
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    w = F.least("w_plus", "w_minus")
    z = F.try_divide(w - mean, F.sqrt(var))
    return sums.select(
        "pair", "n", "w_plus", "w_minus", w.alias("w"), z.alias("z"), two_sided(z).alias("p_value")
    )


def two_sided(z: Column) -> Column:
    """Two-sided normal tail by a continued-fraction-free series for erfc (relative error under 1.2e-7)."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    # Chebyshev fit of erfc (public numerical recipe).
    coefficients = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    poly = reduce(lambda acc, c: F.lit(c) + t * acc, reversed(coefficients[:-1]), F.lit(coefficients[-1]))
    return t * F.exp(-x * x + poly)


def complete_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every column is finite."""
    return table.where(reduce(lambda a, b: a & b, [is_finite(F.col(c)) for c in columns]))


def spearman(
    table: DataFrame, models: tuple = MODELS[1:], group: Column | None = None,
    change: str = "net_canopy_height_change", suffix: str = SUFFIX,
) -> DataFrame:
    """Rank correlation of each model's error with the absolute height change.

    Ranks come from one table of all (group, variable) values, so neither the rows of
    a group nor the frame is ever sorted in one task. Rows: grp, model, rho, n.
    """
    clean = complete_rows(table, [change, *[m + suffix for m in models]])
    label = F.lit("all") if group is None else group
    base = clean.select("tile_id", label.alias("grp"), F.abs(change).alias("_dh"), *[F.col(m + suffix).alias(m) for m in models])
    each = F.array(
        F.struct(F.lit("_dh").alias("var"), F.col("_dh").alias("v")),
        *[F.struct(F.lit(m).alias("var"), F.col(m).alias("v")) for m in models],
    )
    long = base.select("tile_id", "grp", F.explode(each).alias("_e")).select("tile_id", "grp", "_e.*")
    ranked = average_ranks(long, ["grp", "var"], "v").select("grp", "var", "v", "rank")
    rows = long.join(ranked, ["grp", "var", "v"])
    wide = rows.groupBy("grp", "tile_id").agg(*[
        F.max(F.when(F.col("var") == c, F.col("rank"))).alias(c) for c in ("_dh", *models)
    ])
    found = wide.groupBy("grp").agg(*[F.corr("_dh", m).alias(m) for m in models], F.count(F.lit(1)).alias("n"))
    out = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("rho")) for m in models])
    return found.select("grp", "n", F.explode(out).alias("_o")).select("grp", "_o.model", "_o.rho", "n")


def t_p_value(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation from the t distribution, for one result row."""
    if n < 3 or abs(rho) >= 1.0:
        return 0.0 if abs(rho) >= 1.0 else float("nan")
    df = n - 2
    t2 = rho * rho * df / (1.0 - rho * rho)
    return _beta_tail(df / 2.0, 0.5, df / (df + t2))


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return max(0.0, min(1.0, x))
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    value = 1.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1.0 + odd / (1.0 + even / value)
    return front / (a * value)


def compare_correlations(rhos: DataFrame, base: str = "baseline") -> DataFrame:
    """E5: Fisher z of every model's correlation against the base model's."""
    own = rhos.where(F.col("model") == base).select("grp", F.col("rho").alias("_b"))
    others = rhos.where(F.col("model") != base).join(own, "grp")
    z = (F.atanh("_b") - F.atanh("rho")) / F.sqrt(F.lit(2.0) / (F.col("n") - 3))
    return others.select("grp", "model", "rho", "n", z.alias("z"), two_sided(z).alias("p_z"))


def gains_and_losses(change: str = "net_canopy_height_change") -> Column:
    """E6's group key."""
    return F.when(F.col(change) >= 0, F.lit("gains")).otherwise(F.lit("losses"))


def winsorise(
    table: DataFrame, models: tuple, error_cap: float | None = 99.0, height_cap: float | None = 99.0,
    change: str = "net_canopy_height_change", suffix: str = SUFFIX,
) -> DataFrame:
    """Errors capped at a percentile, height changes capped apart for gains and losses."""
    out = complete_rows(table, [change, *[m + suffix for m in models]])
    source = out
    if error_cap is not None:
        rows = long_metrics(source, models, suffix)
        caps = named_percentiles(rows, ["model"], "v", {"q": error_cap / 100.0})
        wide = caps.groupBy().agg(*[F.max(F.when(F.col("model") == m, F.col("q"))).alias(m) for m in models])
        limit = wide.select(F.struct(*models).alias("s")).scalar()
        for m in models:
            out = out.withColumn(m + suffix, F.least(F.col(m + suffix), limit[m]))
    if height_cap is not None:
        side = source.select(gains_and_losses(change).alias("side"), F.abs(change).alias("_h"))
        caps = named_percentiles(side, ["side"], "_h", {"q": height_cap / 100.0})
        wide = caps.groupBy().agg(*[
            F.max(F.when(F.col("side") == s, F.col("q"))).alias(s) for s in ("gains", "losses")
        ])
        limit = wide.select(F.struct("gains", "losses").alias("s")).scalar()
        capped = F.when(F.col(change) >= 0, F.least(F.col(change), limit["gains"])).otherwise(
            F.greatest(F.col(change), -limit["losses"])
        )
        out = out.withColumn(change, capped)
    return out
