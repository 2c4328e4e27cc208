"""Rows picked for a report, shards and per-sample frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tileloom.functions.draws import uniform
from tileloom.operators.metrics import improvement_ratio
from tileloom.operators.ranks import global_percentiles


def top_by(table: DataFrame, order: Column, n: int) -> DataFrame:
    """A top-k with the tile id as tiebreak."""
    return table.orderBy(order, "tile_id").limit(n)


def report_samples(table: DataFrame, model: str, n_loss: int, n_low: int, n_high: int, n_random: int, seed):
    """High losses, low and high improvement, and random others, each with its list name.

    NaN errors sort last, as they do in the reference frames.
    """
    loss = F.col(f"{model}_chamfer_distance")
    ratio = F.try_divide(F.col("input_chamfer_distance"), loss)
    rows = table.where(~F.isnan(loss)).withColumn("ratio", ratio)
    lists = [
        top_by(rows, loss.desc(), n_loss).withColumn("list", F.lit("high_loss")),
        top_by(rows, F.col("ratio").asc(), n_low).withColumn("list", F.lit("low_improvement")),
        top_by(rows, F.col("ratio").desc(), n_high).withColumn("list", F.lit("high_improvement")),
    ]
    chosen = reduce(lambda a, b: a.unionByName(b), lists)
    rest = rows.join(chosen.select("tile_id"), "tile_id", "left_anti")
    drawn = random_rest(rest, n_random, seed).withColumn("list", F.lit("random"))
    return chosen.unionByName(drawn.select(chosen.columns))


def random_rest(rest: DataFrame, n: int, seed) -> DataFrame:
    return rest.orderBy(uniform(seed, F.col("tile_id")), "tile_id").limit(n)


def interesting_tiles(table: DataFrame, model: str = "combined", n: int = 100, extra: DataFrame | None = None):
    """D3: three ranked lists one after the other, each tile at its first position.

    ``extra`` may append hand-picked (tile_id, pos) rows at the end.
    """
    loss = F.col(f"{model}_chamfer_distance")
    middle = global_percentiles(table, "gt_z_std", {"p50": 0.5})["p50"]
    rows = table.where(~F.isnan(loss))
    tall = (F.col("gt_max_z") > 10) & (F.col("gt_z_std") > middle)
    gain = lambda base: F.try_divide(F.col(f"{base}_chamfer_distance"), loss)
    lists = [
        rows.withColumn("_k", -gain("baseline")),
        rows.where(tall).withColumn("_k", loss),
        rows.where(tall & (F.col("input_chamfer_distance") < 2)).withColumn("_k", -gain("input")),
    ]
    parts = []
    for ix, ranked in enumerate(lists):
        first = ranked.select("tile_id", "_k").orderBy("_k", "tile_id").limit(n)
        # at most n rows: the window over them is small
        pos = F.row_number().over(Window.partitionBy(F.lit(ix)).orderBy("_k", "tile_id"))
        parts.append(first.select("tile_id", F.lit(ix).alias("list_ix"), pos.alias("pos")))
    if extra is not None:
        parts.append(extra.select("tile_id", F.lit(len(lists)).alias("list_ix"), F.col("pos").cast("int")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("tile_id").agg(F.min(F.struct("list_ix", "pos")).alias("_p")).select("tile_id", "_p.*")


def rank_thresholds(table: DataFrame, value: Column, n: int = 30) -> DataFrame:
    """The n-th lowest and n-th highest value; NULL below n rows."""
    rows = table.select(value.alias("v")).where(F.col("v").isNotNull())
    low, high = rows.orderBy("v").limit(n), rows.orderBy(F.col("v").desc()).limit(n)
    ends = lambda part, agg: part.agg(F.when(F.count(F.lit(1)) >= n, agg("v")).alias("v")).scalar()
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        "n", ends(low, F.max).alias("low_threshold"), ends(high, F.min).alias("high_threshold")
    )


def overview(table: DataFrame, columns: list[str]) -> DataFrame:
    """Number of samples and the averages of the given columns."""
    return table.agg(F.count(F.lit(1)).alias("n_samples"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def loss_summary(table: DataFrame, value: str) -> DataFrame:
    """Mean loss, least and greatest loss with their tiles."""
    rows = table.where(~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    key = F.struct(value, "tile_id")
    return rows.agg(
        F.avg(value).alias("mean_loss"), F.min(key).alias("_a"), F.max(key).alias("_z")
    ).select(
        "mean_loss", F.col(f"_a.{value}").alias("min_loss"), F.col("_a.tile_id").alias("min_tile"),
        F.col(f"_z.{value}").alias("max_loss"), F.col("_z.tile_id").alias("max_tile"),
    )


def samples_by_model(metrics: DataFrame, models: list[str], names: list[str], require: str = "any") -> DataFrame:
    """Long metrics to one row per tile, a column per model and metric of ``names``.

    ``reference_model`` is the first of ``models`` the tile has. ``require='all'``
    keeps only tiles every model has.
    """
    if require not in ("any", "all"):
        raise ValueError("require must be 'any' or 'all'")
    cells = [
        F.max(F.when((F.col("model") == m) & (F.col("metric") == k), F.col("v"))).alias(f"{m}_{k}")
        for m in models for k in names
    ]
    has = [F.max(F.col("model") == m).alias(f"_has_{m}") for m in models]
    wide = metrics.groupBy("tile_id").agg(*cells, *has)
    first = F.coalesce(*[F.when(F.col(f"_has_{m}"), F.lit(m)) for m in models])
    wide = wide.withColumn("reference_model", first)
    if require == "all":
        wide = wide.where(reduce(lambda a, b: a & b, [F.col(f"_has_{m}") for m in models]))
    return wide.drop(*[f"_has_{m}" for m in models])


def balanced_shards(sizes: DataFrame, workers: int, buckets: int = 4096) -> DataFrame:
    """Tiles dealt to shards by falling size, back and forth.

    A tile's position comes from cumulated counts: of larger sizes (one row per
    distinct size), of lower hash buckets within its size, and its rank inside the
    bucket. So a size that a third of all tiles share is not sorted in one task.
    """
    rows = sizes.withColumn("_b", F.floor(uniform("shard", F.col("tile_id")) * buckets))
    counts = rows.groupBy("size", "_b").agg(F.count(F.lit(1)).alias("_c"))
    per_size = counts.groupBy("size").agg(F.sum("_c").alias("_cs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("size").desc())
    larger = per_size.withColumn("_larger", F.sum("_cs").over(order) - F.col("_cs")).drop("_cs")
    lower = counts.withColumn(
        "_lower", F.sum("_c").over(Window.partitionBy("size").orderBy("_b")) - F.col("_c")
    ).drop("_c")
    starts = lower.join(larger, "size")
    inside = Window.partitionBy("size", "_b").orderBy("tile_id")
    ix = F.col("_larger") + F.col("_lower") + F.row_number().over(inside) - 1
    turn = F.pmod(ix, F.lit(2 * workers))
    shard = F.when(turn < workers, turn).otherwise(F.lit(2 * workers - 1) - turn)
    return rows.join(starts, ["size", "_b"]).select("tile_id", "size", shard.cast("int").alias("shard"))


def shard_report(shards: DataFrame) -> DataFrame:
    per = shards.groupBy("shard").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n_tiles"))
    return per.agg(
        F.min("total").alias("min_total"), F.max("total").alias("max_total"), F.avg("total").alias("avg_total"),
        F.min("n_tiles").alias("min_tiles"), F.max("n_tiles").alias("max_tiles"),
    )


__all__ = [
    "top_by", "report_samples", "random_rest", "interesting_tiles", "rank_thresholds", "overview",
    "loss_summary", "samples_by_model", "balanced_shards", "shard_report", "improvement_ratio",
]
