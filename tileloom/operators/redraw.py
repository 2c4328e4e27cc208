"""Augmented tiles that must pass the checks.

A tile whose augmentation breaks a rule gets its original back; a copy that breaks one is drawn
again. Both are set-wise: tiles are judged by one aggregate over all their points, and joins on
tile ids decide which version goes on. A round of drawing handles all missing copies at once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tileloom.functions.draws import uniform
from tileloom.operators.augment import augment_points, systematic
from tileloom.operators.neighbors import edge_table
from tileloom.operators.ranks import lowest_n
from tileloom.session import cut_lineage, written

#: Steps of the sequence that move, add or drop points.
POINT_STEPS = ("rotate", "reflect", "jitter", "add_points", "remove_points", "mask_points", "remove_slice")


#: A round draws at most this many times the copies that are missing.
AHEAD = 8


class Kept(NamedTuple):
    """Points that go on, and per tile what became of it."""

    points: DataFrame
    outcome: DataFrame


class Redrawn(NamedTuple):
    """Accepted copies, their points, and per tile how its draws ended."""

    copies: DataFrame
    points: DataFrame
    report: DataFrame


def judged(made: DataFrame, wanted: DataFrame, broken: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(tile_id, violation) of each wanted tile that breaks a rule or has lost all its points."""
    gone = wanted.join(made.select("tile_id").distinct(), "tile_id", "left_anti")
    return broken(made).select("tile_id", "violation").unionByName(
        gone.select("tile_id", F.lit("no_points").alias("violation"))
    )


def augment_or_keep(
    points: DataFrame, seed, draws: DataFrame, broken: Callable[[DataFrame], DataFrame],
    attributes: list[str] | None = None,
) -> Kept:
    """A12 with its way back: tiles that break a rule afterwards keep their original points.

    ``broken`` gives (tile_id, violation) rows for the points of many tiles. The outcome has one row
    per tile: tile_id, augmented (whether the new version goes on), changed (whether a step moved,
    added or dropped points of a version that goes on) and the sorted violations.
    """
    points = written(points)
    tiles = points.select("tile_id").distinct()
    made = written(augment_points(points, seed, draws, attributes))
    bad = judged(made, tiles, broken).groupBy("tile_id").agg(F.array_sort(F.collect_set("violation")).alias("violations"))
    drawn = draws.select("tile_id", F.greatest(*[F.col("do_" + s) for s in POINT_STEPS]).alias("_drawn"))
    outcome = tiles.join(bad, "tile_id", "left").join(drawn, "tile_id", "left").select(
        "tile_id",
        F.col("violations").isNull().alias("augmented"),
        (F.col("violations").isNull() & F.coalesce("_drawn", F.lit(False))).alias("changed"),
        F.coalesce("violations", F.array().cast("array<string>")).alias("violations"),
    )
    outcome = cut_lineage(outcome)
    failed = outcome.where(~F.col("augmented")).select("tile_id")
    kept = made.join(failed, "tile_id", "left_anti").unionByName(points.join(failed, "tile_id", "left_semi"))
    return Kept(kept, outcome)


def regraph(kept: Kept, stored: DataFrame, k: int) -> DataFrame:
    """Edges after :func:`augment_or_keep`: the stored ones of unchanged tiles, new ones of the others."""
    changed = kept.outcome.where("changed").select("tile_id")
    fresh = edge_table(kept.points.join(changed, "tile_id", "left_semi"), k)
    alive = kept.outcome.where("not changed").select("tile_id")
    return stored.where(F.col("k") == k).join(alive, "tile_id", "left_semi").unionByName(fresh.select(stored.columns))


def shares_within(weights: DataFrame, total: int) -> DataFrame:
    """Expected copies of each tile: in proportion to ``p``, at most its ``room``, together ``total``.

    What the rooms cut off goes to the others in proportion. The common factor is found from global
    sums and only grows, and with it the number of full tiles, so the search ends once a pass adds none.
    """
    weights = cut_lineage(weights)
    sums = weights.agg(F.sum("p").alias("p"), F.sum("room").alias("room")).first()
    if not sums["p"]:
        return weights.withColumn("expected", F.lit(0.0))
    if sums["room"] <= total:
        return weights.withColumn("expected", F.col("room").cast("double"))
    factor, full = total / sums["p"], -1
    while True:
        over = F.col("p") * F.lit(factor) >= F.col("room")
        seen = weights.agg(
            F.count(F.when(over, 1)).alias("k"), F.coalesce(F.sum(F.when(over, F.col("room"))), F.lit(0)).alias("room"),
            F.sum(F.when(~over, F.col("p"))).alias("rest"),
        ).first()
        if seen["k"] == full or not seen["rest"]:
            break
        full, factor = seen["k"], (total - seen["room"]) / seen["rest"]
    return weights.withColumn("expected", F.least(F.col("p") * F.lit(factor), F.col("room").cast("double")))


def redrawn_copies(
    weights: DataFrame, total: int, seed, make: Callable[[DataFrame], DataFrame],
    broken: Callable[[DataFrame], DataFrame], cap: int | None = None, attempts: int = 100,
) -> Redrawn:
    """``total`` accepted copies, drawn again in rounds until there are as many.

    ``weights`` has tile_id and p. ``make`` gets the copies of a round (tile_id, attempt, new_id) and
    returns their augmented points under tile_id = new_id; its draws are keyed by that id, so by
    tile and attempt. ``broken`` gives (tile_id, violation) rows. A tile gives at most ``cap`` accepted
    copies and is tried at most ``attempts`` times. A round draws the missing number among the tiles
    that still have room, after the first one as many more as were rejected so far (at most ``AHEAD``
    times as many); of those that pass the missing number is taken by a hash draw. So a few rounds end
    with the total or with no room left. A tile with p of 0 or null is never drawn. The report has
    one row per tile: accepted, spare (passed, not needed), rejected and status, which is full (at its
    cap), exhausted (out of attempts below its cap) or open.
    """
    most = F.lit(attempts) - F.col("tried")
    room = most if cap is None else F.least(most, F.lit(cap) - F.col("accepted"))
    zero = F.lit(0).cast("long")
    counts = [zero.alias(c) for c in ("accepted", "passed", "tried")]
    state = cut_lineage(weights.select("tile_id", "p", *counts))
    copies, points, left, asked = [], [], total, total
    while left > 0:
        key = f"{seed}_{len(copies)}"
        open_ = state.where((F.col("p") > 0) & (room > 0)).select("tile_id", "p", "tried", room.alias("room"))
        drawn = systematic(shares_within(open_, asked), key)
        last = F.col("tried") + F.col("n") - 1
        ids = open_.join(drawn, "tile_id").select("tile_id", F.explode(F.sequence(F.col("tried"), last)).alias("attempt"))
        ids = cut_lineage(ids.withColumn("new_id", F.concat_ws("_aug_", "tile_id", F.col("attempt").cast("string"))))
        if ids.isEmpty():
            break
        made = cut_lineage(make(ids))
        bad = judged(made, ids.select(F.col("new_id").alias("tile_id")), broken).select(F.col("tile_id").alias("new_id"))
        fine = cut_lineage(ids.join(bad.distinct(), "new_id", "left_anti").select(
            "tile_id", "attempt", "new_id", F.lit(len(copies)).alias("round")
        ))
        taken = cut_lineage(lowest_n(fine, ["round"], uniform(key, "keep", F.col("new_id")), left, ["new_id"]))
        copies.append(taken)
        points.append(made.join(taken.select(F.col("new_id").alias("tile_id")), "tile_id", "left_semi"))
        news = [
            df.groupBy("tile_id").agg(F.count(F.lit(1)).alias("_" + c))
            for df, c in ((taken, "accepted"), (fine, "passed"), (ids, "tried"))
        ]
        for new in news:
            state = state.join(new, "tile_id", "left")
        grown = [(F.col(c) + F.coalesce("_" + c, zero)).alias(c) for c in ("accepted", "passed", "tried")]
        state = cut_lineage(state.select("tile_id", "p", *grown))
        sums = state.agg(*[F.sum(c).alias(c) for c in ("accepted", "passed", "tried")]).first()
        left = total - sums["accepted"]
        asked = min(AHEAD * left, -(-left * sums["tried"] // max(1, sums["passed"])))
    status = F.when(F.col("tried") >= attempts, F.lit("exhausted")).otherwise(F.lit("open"))
    if cap is not None:
        status = F.when(F.col("accepted") >= cap, F.lit("full")).otherwise(status)
    report = state.select(
        "tile_id", "accepted", (F.col("passed") - F.col("accepted")).alias("spare"),
        (F.col("tried") - F.col("passed")).alias("rejected"), status.alias("status"),
    )
    if not copies:
        none = state.where(F.lit(False)).select("tile_id", zero.alias("attempt"), F.col("tile_id").alias("new_id"), F.lit(0).alias("round"))
        return Redrawn(none, make(none.drop("round")), report)
    return Redrawn(_together(copies), _together(points), report)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
