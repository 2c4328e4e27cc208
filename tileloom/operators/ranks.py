"""Order statistics that never sort a whole group in one task.

A tile, a cell or a model may hold a third of all rows. So ranks, percentiles,
running totals and "lowest n" picks go through buckets: rows are bucketed by a
deterministic rule, bucket counts (few rows) are cumulated, and only the rows
inside one bucket are ever ordered together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tileloom.session import cut_lineage

ROWS_PER_BUCKET = 100_000
HASH_BUCKETS = 65_536
HOT_GROUP_ROWS = 2_000_000
#: Rows of one key that a task reads where they meet the key's bounds; keys of more rows are dealt to several.
ROWS_MET = 500_000


def totals(df: DataFrame, **aggregates: Column) -> Column:
    """Global aggregates of ``df`` as one struct column, computed once (scalar subquery)."""
    one = df.agg(*[c.alias(n) for n, c in aggregates.items()])
    return one.select(F.struct(*aggregates)).scalar()


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the caller calls its own."""
    have = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        free.append(name)
    return free


def lowest_n(
    df: DataFrame,
    group: list[str],
    draw: Column,
    keep: Callable[[Column], Column] | int,
    tiebreak: list[str],
    buckets: int = HASH_BUCKETS,
) -> DataFrame:
    """Exactly the rows with the n lowest draws per group.

    ``draw`` is uniform in [0, 1), so ``floor(draw * buckets)`` spreads any group
    evenly. The counts per bucket (at most ``buckets`` rows per group) tell in which
    bucket the n-th row falls; buckets above are dropped, and rows are only ranked
    against the rows of their own bucket.

    ``keep`` is a number, or a function from the group's row count to n. A group of
    fewer rows keeps all of them; n of zero or less keeps none.
    """
    wanted = keep if callable(keep) else (lambda _: F.lit(keep))
    columns = df.columns
    u, b, c, n, want, before, last, left, rn = spare(
        df, "_u", "_b", "_c", "_n", "_want", "_before", "_last", "_left", "_rn"
    )
    rows = df.withColumn(u, draw).withColumn(b, F.floor(F.col(u) * F.lit(buckets)))
    whole = Window.partitionBy(*group)
    limit = (
        rows.groupBy(*group, b)
        .agg(F.count(F.lit(1)).alias(c))
        .withColumn(n, F.sum(c).over(whole))
        .withColumn(want, F.least(wanted(F.col(n)).cast("long"), F.col(n)))
        .withColumn(before, F.sum(c).over(whole.orderBy(b)) - F.col(c))
        .where((F.col(before) < F.col(want)) & (F.col(want) <= F.col(before) + F.col(c)))
        .select(*group, F.col(b).alias(last), (F.col(want) - F.col(before)).alias(left))
    )
    inside = Window.partitionBy(*group, b).orderBy(u, *tiebreak)
    return (
        rows.join(limit, group)
        .where(F.col(b) <= F.col(last))
        .withColumn(rn, F.row_number().over(inside))
        .where((F.col(b) < F.col(last)) | (F.col(rn) <= F.col(left)))
        .select(*columns)
    )


def width_bucket(hist, keys, value, name, rows_per_bucket):
    """Equal-width buckets between the least and greatest value of each key.

    A key may hold all rows: where one has many, rows meet a copy of their key's bounds per share of a hash.
    """
    span = cut_lineage(hist.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_m")
    ))
    shares = math.ceil((span.agg(F.max("_m")).first()[0] or 0) / ROWS_MET)
    parts = F.ceil(F.col("_m") / F.lit(rows_per_bucket))
    share = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bucket = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * parts), parts - 1)
    if shares > 1:
        (at,) = spare(hist, "_share")
        dealt = hist.withColumn(at, F.pmod(F.xxhash64(value), F.lit(shares)).cast("int"))
        every = span.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        met = dealt.join(every, [*keys, at]).drop(at)
    else:
        met = hist.join(span, keys)
    return met.withColumn(name, bucket).drop("_lo", "_hi", "_m")


def cumulative_histogram(
    df: DataFrame,
    group: list[str],
    value: str,
    weight: Column | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per group and distinct value: ``c`` (weight at the value), ``start`` (weight below).

    Equal values meet in a partial aggregate first. Two rounds of equal-width
    buckets follow: the second splits what a long tail crowded into one bucket of
    the first, measured on a logarithmic scale. The histogram is written once, as
    the steps below read it several times.
    """
    w = F.lit(1) if weight is None else weight
    hist = df.groupBy(*group, value).agg(F.sum(w).alias("c"))
    hist = cut_lineage(hist)
    scaled = F.signum(F.col(value)) * F.log1p(F.abs(F.col(value)))
    hist = hist.withColumn("_t", scaled)
    hist = width_bucket(hist, group, "_t", "_b1", rows_per_bucket)
    hist = width_bucket(hist, [*group, "_b1"], value, "_b2", rows_per_bucket)
    across = Window.partitionBy(*group).orderBy("_b1", "_b2")
    starts = (
        hist.groupBy(*group, "_b1", "_b2")
        .agg(F.sum("c").alias("_bc"))
        .withColumn("_bs", F.sum("_bc").over(across) - F.col("_bc"))
        .drop("_bc")
    )
    inside = Window.partitionBy(*group, "_b1", "_b2").orderBy(value)
    return (
        hist.join(starts, [*group, "_b1", "_b2"])
        .withColumn("start", F.col("_bs") + F.sum("c").over(inside) - F.col("c"))
        .select(*group, value, "c", "start")
    )


def average_ranks(df: DataFrame, group: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ties share the mean of the ranks they span. One row per distinct value."""
    ranked = cumulative_histogram(df, group, value)
    mean_rank = (F.col("start") + F.lit(1) + F.col("start") + F.col("c")) / F.lit(2.0)
    return ranked.select(*group, value, "c", mean_rank.alias(out))


def _interpolated(hist, group, value, ps):
    total = hist.groupBy(*group).agg(F.sum("c").alias("_n"))
    rows = hist.join(total, group)
    picks = []
    for i, p in enumerate(ps):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for tag, k in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            inside = (F.col("start") <= k) & (k < F.col("start") + F.col("c"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{tag}{i}"))
    got = rows.groupBy(*group).agg(F.max("_n").alias("_n"), *picks)
    values = []
    for i, p in enumerate(ps):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        values.append(low + (high - low) * (pos - F.floor(pos)))
    return got.select(*group, F.array(*values).alias("q"))


def has_hot_group(df: DataFrame, group: list[str], most: int) -> bool:
    """Whether any group has more rows than one task should hold (one small job)."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return not sizes.where(F.col("_n") > most).isEmpty()


def percentiles(
    df: DataFrame,
    group: list[str],
    value: str,
    ps: list[float],
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, as an array column ``q``.

    Ordinary groups use the built-in aggregate, whose state is one value-to-count
    map per group. The group sizes are measured first; when some group is larger
    than ``hot_rows`` those groups go through the bucketed histogram instead, so no
    task ever holds one. Null values are left out.
    """
    taken = {"q", "c", "start", "_n", "_t", "_b1", "_b2", "_bc", "_bs", "_lo", "_hi", "_m"} & {*group, value}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are named like helper columns; rename them first")
    rows = df.where(F.col(value).isNotNull()).select(*group, value)
    built_in = F.percentile(value, F.array(*[F.lit(float(p)) for p in ps])).alias("q")
    if not has_hot_group(rows, group, hot_rows):
        return rows.groupBy(*group).agg(built_in)
    rows = cut_lineage(rows)
    hot = (
        rows.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*group)
    )
    usual = rows.join(hot, group, "left_anti").groupBy(*group).agg(built_in)
    crowded = cumulative_histogram(rows.join(hot, group, "left_semi"), group, value)
    return usual.unionByName(_interpolated(cut_lineage(crowded), group, value, ps))


def named_percentiles(df, group, value, names: dict[str, float], **options) -> DataFrame:
    """As :func:`percentiles`, one column per entry of ``names``."""
    found = percentiles(df, group, value, list(names.values()), **options)
    return found.select(*group, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def global_percentiles(df: DataFrame, value: str, names: dict[str, float]) -> Column:
    """Percentiles over the whole frame as a struct column (scalar subquery)."""
    one = "one_group" if value != "one_group" else "one_group_"
    found = named_percentiles(df.select(F.lit(0).alias(one), value), [one], value, names)
    return found.select(F.struct(*names)).scalar()


def running_total(
    df: DataFrame, value: str, seed, key: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Cumulative sum over the whole frame in hash order of ``key`` (column ``upto``).

    The hash spreads rows evenly over buckets, so the only window over everything
    runs on one row per bucket.
    """
    from tileloom.functions.draws import uniform

    count = totals(df, n=F.count(F.lit(1)))
    u, b, part, before = spare(df, "_u", "_b", "_s", "_before")
    rows = df.withColumn(u, uniform(seed, F.col(key)))
    rows = rows.withColumn(b, F.floor(F.col(u) * F.ceil(count["n"] / F.lit(rows_per_bucket))))
    per_bucket = rows.groupBy(b).agg(F.sum(value).alias(part))
    earlier = per_bucket.withColumn(
        before, F.sum(part).over(Window.partitionBy(F.lit(0)).orderBy(b)) - F.col(part)
    ).drop(part)
    inside = Window.partitionBy(b).orderBy(u, key)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(earlier, b)
        .withColumn("upto", F.col(before) + F.sum(value).over(inside))
        .drop(u, b, before)
    )


def numbered(df: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """All rows numbered from 0 in the global order of the columns ``order``.

    The sorted rows are written range by range; a range's rows are numbered where they lie, and the
    counts of the ranges before (one row per range) move the numbers on. Rows equal in ``order`` come
    in the order of their ranges, so order by a unique key for numbers that are the same on every run.
    """
    at, part, n, before = spare(df, "_at", "_part", "_n", "_before")
    rows = cut_lineage(df.orderBy(*order)).withColumn(at, F.monotonically_increasing_id())
    rows = rows.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    ranges = rows.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    earlier = ranges.select(part, (F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(part)) - F.col(n)).alias(before))
    return rows.join(earlier, part).withColumn(out, F.col(before) + F.col(at)).drop(at, part, before)


def numbered_within(df: DataFrame, group: list[str], order: list[str], out: str = "number") -> DataFrame:
    """Rows numbered from 0 inside each group, which may lie in many tasks."""
    whole, first = spare(df, "_whole", "_first")
    rows = numbered(df, [*group, *order], whole)
    names = spare(rows, *["_" + g for g in group])
    start = rows.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)]).agg(F.min(whole).alias(first))
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)]
    return rows.join(start, same).select(*df.columns, (F.col(whole) - F.col(first)).alias(out))
