"""Downsampling by voxels and octants, for all tiles at once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tileloom.operators.neighbors import _codes, _numbers
from tileloom.operators.ranks import spare
from tileloom.session import cut_lineage, written

AXES = ("x", "y", "z")
#: A tile of at most this many points is searched for its voxel size by one call, which gets about ROWS_MET of many tiles.
POINTS_SEARCHED, ROWS_MET = 1 << 16, 1 << 16
#: Largest coordinate of such a tile (voxel numbers stay whole).
WIDEST = 1e9


def _even() -> Column:
    """Whether a tile's coordinates are all there and of a size that voxel numbers stay whole."""
    there = [F.coalesce(F.max(F.abs(a)) < WIDEST, F.lit(False)) & (F.count(a) == F.count(F.lit(1))) for a in AXES]
    return there[0] & there[1] & there[2] & F.col("tile_id").isNotNull()


def _plain(points: DataFrame) -> bool:
    return {t for n, t in points.dtypes if n in AXES} == {"double"}


def _origins(points: DataFrame) -> DataFrame:
    return points.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_points"), *[F.min(a).alias(f"_{a}0") for a in AXES]
    )


def _voxels(points: DataFrame, frame: DataFrame, ratio: float) -> DataFrame:
    """Points with voxel indices; ``frame`` has tile_id, the tile's least coordinates and ``size``."""
    rows = points.join(frame, "tile_id")
    for a in AXES:
        edge = F.col("size") * F.lit(ratio if a == "z" else 1.0)
        rows = rows.withColumn(f"_v{a}", F.floor((F.col(a) - F.col(f"_{a}0")) / edge))
    return rows.drop("size", *[f"_{a}0" for a in AXES])


def _framed(points: DataFrame, sizes: DataFrame) -> DataFrame:
    return _origins(points).drop("n_points").join(sizes.select("tile_id", "size"), "tile_id")


def _per_tile(points: DataFrame, size: float) -> DataFrame:
    return points.select("tile_id").distinct().withColumn("size", F.lit(float(size)))


def voxel_downsample(points: DataFrame, size: float | DataFrame, ratio: float = 1.0) -> DataFrame:
    """V1/V2: per voxel the point nearest the centroid of the voxel's points.

    ``size`` is metres or a table (tile_id, size); ``ratio`` is the vertical edge over
    the horizontal one. Distances are compared to nine places (two points of a voxel
    are equally far from their middle), ties go to the smaller pid. Both steps are
    partial aggregates.
    """
    sizes = size if isinstance(size, DataFrame) else _per_tile(points, size)
    key = ["tile_id", *[f"_v{a}" for a in AXES]]
    rows = _voxels(points, _framed(points, sizes), ratio)
    centre = rows.groupBy(*key).agg(*[F.avg(a).alias(f"_c{a}") for a in AXES])
    gaps = [F.pow(F.col(a) - F.col(f"_c{a}"), 2) for a in AXES]
    off = F.round(gaps[0] + gaps[1] + gaps[2], 9)
    order = F.struct(off, "pid", *AXES)
    best = rows.join(centre, key).groupBy(*key).agg(F.min_by(F.struct(*points.columns), order).alias("_p"))
    return best.select("_p.*")


def voxel_counts(points: DataFrame, sizes: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Number of occupied voxels per tile: two levels of partial aggregates."""
    frame = _framed(points, sizes).withColumn("_trial", F.lit(0))
    return _count_trials(points, frame, ratio).select("tile_id", F.col("_c0").alias("n_voxels"))


def _count_trials(points: DataFrame, frame: DataFrame, ratio: float, trials: int = 1) -> DataFrame:
    """Occupied voxels of each tile at each of its trial sizes, as columns _c0, _c1, ..."""
    key = ["tile_id", "_trial", *[f"_v{a}" for a in AXES]]
    occupied = _voxels(points.select("tile_id", *AXES), frame, ratio).groupBy(*key).agg(F.lit(1).alias("_o"))
    return occupied.groupBy("tile_id").agg(
        *[F.count(F.when(F.col("_trial") == i, 1)).alias(f"_c{i}") for i in range(trials)]
    )


def adaptive_sizes(
    points: DataFrame, most: int, start_cm: float | DataFrame = 4.0, ratio: float = 1.0,
    keep_if_small: bool = True, rounds: int = 10, width: float = 0.5, growth_passes: int = 400,
) -> DataFrame:
    """V3: the voxel size per tile that leaves at most ``most`` points.

    Tiles of few points are searched where their points meet, many tiles a call. The others by
    set-wise bisection: one pass counts the voxels of every tile still searching at
    the tile's own middle size and at the two sizes that can come next, so a pass
    settles two halvings. Tiles whose bracket never reaches the cap grow their size
    afterwards, again all of them per pass. The state is one row per tile.
    Columns tile_id, size_cm, n_points, whole (all points kept).
    """
    base = points.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_points"), *[F.min(a).alias(f"_{a}0") for a in AXES],
        _even().alias("_even"),
    )
    if isinstance(start_cm, DataFrame):
        base = base.join(start_cm.select("tile_id", F.col("size_cm").alias("lo")), "tile_id")
    else:
        base = base.withColumn("lo", F.lit(float(start_cm)))
    whole = (F.col("n_points") <= most) if keep_if_small else F.lit(False)
    frame = ["tile_id", *[f"_{a}0" for a in AXES]]
    fixed = [*frame, "n_points", "first", "whole"]
    few = F.col("_even") & (F.col("n_points") <= (POINTS_SEARCHED if _plain(points) else 0)) & F.col("lo").isNotNull()
    base = cut_lineage(base.withColumn("_few", F.coalesce(few, F.lit(False)) | whole).withColumn("whole", whole))
    sorts = base.agg(
        F.count(F.when(F.col("_few") & ~F.col("whole"), 1)).alias("few"), F.count(F.when(~F.col("_few"), 1)).alias("many"),
        F.coalesce(F.sum(F.when(F.col("_few") & ~F.col("whole"), F.col("n_points"))), F.lit(0)).alias("rows"),
    ).first()
    of = lambda some: points.join(base.where(some).select("tile_id"), "tile_id", "left_semi").select(points.columns)
    settled = base.where("_few and whole").select("tile_id", F.col("lo").alias("size_cm"), "n_points", "whole")
    if sorts["few"]:
        small = base.where("_few and not whole")
        asked = of("_few and not whole") if sorts["many"] or keep_if_small else points
        found = _searched(asked, small, sorts["rows"], most, ratio, rounds, width, growth_passes)
        settled = settled.unionByName(cut_lineage(found))
    if not sorts["many"]:
        return settled
    points = of(~F.col("_few")) if sorts["few"] else points
    state = cut_lineage(base.where(~F.col("_few")).withColumn("first", F.col("lo")).select(
        *fixed, "lo", (F.col("lo") * 10).alias("hi"),
        F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("best_n"),
    ))
    searching = lambda: ~F.col("whole") & (F.col("hi") - F.col("lo") > width)

    def halve(rows: DataFrame, count: Column) -> DataFrame:
        mid = (F.col("lo") + F.col("hi")) / 2
        fits = count <= most
        better = fits & (F.col("best_n").isNull() | (count > F.col("best_n")))
        on = searching() & count.isNotNull()
        return rows.withColumn("_mid", mid).withColumn("_n", F.when(on, count)).withColumns({
            "_fits": F.coalesce(on & fits, F.lit(False)), "_better": F.coalesce(on & better, F.lit(False)),
        }).withColumns({
            "best": F.when(F.col("_better"), F.col("_mid")).otherwise(F.col("best")),
            "best_n": F.when(F.col("_better"), F.col("_n")).otherwise(F.col("best_n")),
            "hi": F.when(F.col("_fits"), F.col("_mid")).otherwise(F.col("hi")),
            "lo": F.when(F.col("_n").isNotNull() & ~F.col("_fits"), F.col("_mid")).otherwise(F.col("lo")),
        })

    for done in range(0, rounds, 2):
        open_ = state.where(searching())
        if open_.isEmpty():
            break
        mid = (F.col("lo") + F.col("hi")) / 2
        sizes = F.array(mid / 100, (F.col("lo") + mid) / 2 / 100, (mid + F.col("hi")) / 2 / 100)
        trials = open_.select(*frame, F.posexplode(sizes).alias("_trial", "size"))
        joined = state.join(_count_trials(points, trials, ratio, 3), "tile_id", "left")
        once = halve(joined, F.col("_c0"))
        if done + 1 < rounds:
            once = once.withColumn("_next", F.when(F.col("_fits"), F.col("_c1")).otherwise(F.col("_c2")))
            once = halve(once, F.col("_next"))
        state = cut_lineage(once.select(*fixed, "lo", "hi", "best", "best_n"))
    state = state.withColumn("cur", F.col("lo"))
    factor = 0.5
    for step in range(growth_passes + 1):
        open_ = state.where(~F.col("whole") & F.col("best").isNull())
        if open_.isEmpty():
            break
        if step == growth_passes:
            raise RuntimeError("voxel sizes did not reach the cap; raise growth_passes")
        trials = open_.select(*frame, F.lit(0).alias("_trial"), (F.col("cur") / 100).alias("size"))
        counted = _count_trials(points, trials, ratio)
        over = F.col("_c0").cast("double") / F.lit(float(most))
        more = F.lit(2.0) * over if ratio == 1.0 else F.least(F.lit(5.0), F.lit(factor) * over)
        fits = F.col("_c0") <= most
        state = cut_lineage(state.join(counted, "tile_id", "left").select(
            *fixed, "lo", "hi",
            F.when(fits, F.col("cur")).otherwise(F.col("best")).alias("best"),
            F.when(fits, F.col("_c0")).otherwise(F.col("best_n")).alias("best_n"),
            F.when(F.col("_c0").isNotNull() & ~fits, F.col("cur") + more).otherwise(F.col("cur")).alias("cur"),
        ))
        factor *= 1.2
    size = F.when(F.col("whole"), F.col("first")).otherwise(F.col("best"))
    return settled.unionByName(state.select("tile_id", size.alias("size_cm"), "n_points", "whole"))


def _occupied(xyz: np.ndarray, least: np.ndarray, size: float, ratio: float) -> int:
    """The number of voxels of a size (metres) that hold points."""
    index = [np.floor((xyz[c] - least[c]) / (size * (ratio if a == "z" else 1.0))) for c, a in enumerate(AXES)]
    spans = [i.max() + 1 for i in index]
    if spans[0] * spans[1] * spans[2] >= 2.0**53:
        return len(np.unique(np.column_stack(index), axis=0))
    codes = np.sort((index[0] * spans[1] + index[1]) * spans[2] + index[2])
    return 1 + np.count_nonzero(codes[1:] != codes[:-1])


def _fitting_size(count, first: float, most: int, ratio: float, rounds: int, width: float, growth_passes: int) -> float:
    """V3's search for one tile; ``count`` tells the occupied voxels at a size in cm."""
    lo, hi, best, best_n = first, first * 10, None, None
    for _ in range(rounds):
        if not hi - lo > width:
            break
        mid = (lo + hi) / 2
        n = count(mid)
        if n > most:
            lo = mid
            continue
        if best is None or n > best_n:
            best, best_n = mid, n
        hi = mid
    if best is not None:
        return best
    cur, factor = lo, 0.5
    for _ in range(growth_passes):
        n = count(cur)
        if n <= most:
            return cur
        over = n / most if most else math.inf
        cur += 2.0 * over if ratio == 1.0 else min(5.0, factor * over)
        factor *= 1.2
    raise RuntimeError("voxel sizes did not reach the cap; raise growth_passes")


def _searched(points: DataFrame, tiles: DataFrame, rows: int, most, ratio, rounds, width, growth_passes) -> DataFrame:
    """The voxel sizes of tiles of few points: the points of many tiles meet in a call, each tile is searched by itself."""
    buckets = F.lit(max(1, math.ceil(rows / ROWS_MET)))
    dealt = lambda df, tile: df.withColumn("_bucket", F.pmod(F.xxhash64(tile), buckets)).repartition("_bucket")
    least = [f"_{a}0" for a in AXES]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        tile = right["_tile"].combine_chunks()
        own = pc.index_in(left["tile_id"].combine_chunks(), tile).fill_null(-1).to_numpy()
        order = np.argsort(own, kind="stable")
        xyz = [left[a].to_numpy()[order] for a in AXES]
        starts = np.column_stack([right[n].to_numpy() for n in least])
        ends = [np.searchsorted(own[order], np.arange(len(tile)), side) for side in ("left", "right")]
        sizes = []
        for t, (lo, begin, end) in enumerate(zip(right["lo"].to_pylist(), *ends)):
            mine = [x[begin:end] for x in xyz]
            count = lambda cm: _occupied(mine, starts[t], cm / 100, ratio)
            sizes.append(_fitting_size(count, lo, most, ratio, rounds, width, growth_passes))
        return pa.table({"tile_id": tile, "size_cm": pa.array(sizes, pa.float64()), "n_points": right["n_points"], "whole": right["whole"]})

    states = tiles.select(F.col("tile_id").alias("_tile"), *least, "lo", "n_points", "whole")
    met = dealt(points.select("tile_id", *AXES), "tile_id").groupBy("_bucket").cogroup(dealt(states, "_tile").groupBy("_bucket"))
    kind = dict(tiles.dtypes)["tile_id"]
    return met.applyInArrow(search, f"tile_id {kind}, size_cm double, n_points long, whole boolean")


def _nearest_centre(tile: np.ndarray, xyz: list[np.ndarray], pid: np.ndarray, least: list[np.ndarray], size: np.ndarray, ratio: float, copies: bool) -> np.ndarray:
    """V1 for rows of many tiles: the rows kept, per voxel one or (``copies``) all that equal it.

    ``least`` and ``size`` (metres) are those of each row's tile.
    """
    index = [np.floor((xyz[c] - least[c]) / (size * (ratio if a == "z" else 1.0))) for c, a in enumerate(AXES)]
    order = np.lexsort((*index[::-1], tile))
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in (tile, *index)], axis=0)])[: len(order)]
    starts, voxel = np.flatnonzero(new), np.cumsum(new) - 1
    if not len(starts):
        return order
    n = np.diff(starts, append=len(order))
    off = sum((xyz[c][order] - (np.add.reduceat(xyz[c][order], starts) / n)[voxel]) ** 2 for c in range(3))
    # Half up at nine places, as the engine rounds; large numbers have no such places.
    off = np.where(off < 2.0**22, np.floor(off * 1e9 + 0.5) / 1e9, off)
    near = np.flatnonzero(off == np.minimum.reduceat(off, starts)[voxel])
    rows, of = order[near], voxel[near]
    keys = [pid[rows], *(xyz[c][rows] for c in range(3))]
    by = np.lexsort((*keys[::-1], of))
    rows, of, keys = rows[by], of[by], [k[by] for k in keys]
    first = np.concatenate([[True], of[1:] != of[:-1]])
    if not copies:
        return rows[first]
    run = np.cumsum(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in (of, *keys)], axis=0)]))
    return rows[run == run[first][of]]


class _Thinning:
    """V3 and V4 for tiles of few points, whose rows meet in a call: the rows kept for each cap, the largest first."""

    def __init__(self, caps, start_cm, ratio=1.0, keep_if_small=True, rounds=10, width=0.5, growth_passes=400):
        self.caps, self.start, self.ratio, self.small = sorted(caps, reverse=True), float(start_cm), ratio, keep_if_small
        self.search = rounds, width, growth_passes

    def kept(self, tile: np.ndarray, xyz: list[np.ndarray], pid: np.ndarray, copies: bool = False) -> list[np.ndarray]:
        """Row numbers per cap; ``tile`` has the tiles' numbers, ``pid`` numbers of the points' order."""
        order = np.argsort(tile, kind="stable")
        starts = np.flatnonzero(np.diff(tile[order], prepend=-1))
        n = np.diff(starts, append=len(order))
        if not len(starts):
            return [order for _ in self.caps]
        of = np.repeat(np.arange(len(starts)), n)
        axes = [x[order] for x in xyz]
        least = [np.minimum.reduceat(x, starts) for x in axes]
        size, found = np.full(len(starts), self.start), []
        for cap in self.caps:
            whole = (n <= cap) & self.small
            for t in np.flatnonzero(~whole):
                mine = [x[starts[t] : starts[t] + n[t]] for x in axes]
                corner = [x[t] for x in least]
                count = lambda cm: _occupied(mine, corner, cm / 100, self.ratio)
                size[t] = _fitting_size(count, size[t], cap, self.ratio, *self.search)
            cut = np.flatnonzero(~whole[of])
            t = of[cut]
            thin = _nearest_centre(t, [x[cut] for x in axes], pid[order][cut], [x[t] for x in least], size[t] / 100, self.ratio, copies)
            found.append(order[np.concatenate([np.flatnonzero(whole[of]), cut[thin]])])
        return found


def _numbered(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of a table's rows: numbers of their tiles, the coordinates, and numbers of the points' order."""
    tile = _codes([table["tile_id"]], [table["tile_id"].slice(0, 0)])[0]
    return tile, [table[a].to_numpy() for a in AXES], _numbers(table["pid"])[0]


def _met(rows: DataFrame, number: int, work, schema) -> DataFrame:
    """``work`` on the rows of whole tiles, many tiles a call; ``number``: how many rows there are."""
    calls = lambda batches: (
        batch for held in [list(batches)] if sum(b.num_rows for b in held) for batch in work(pa.Table.from_batches(held).combine_chunks()).to_batches()
    )
    return rows.repartition(max(1, math.ceil(number / ROWS_MET)), "tile_id").mapInArrow(calls, schema)


def _by_size(points: DataFrame, *more: Column) -> tuple[DataFrame, int, int]:
    """(tile_id, _few, n_points and ``more``) of the tiles, the points of those with few, and the number of the others."""
    few = F.coalesce(_even() & (F.count(F.lit(1)) <= (POINTS_SEARCHED if _plain(points) else 0)), F.lit(False))
    tiles = points.where(F.col("tile_id").isNotNull()).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_points"), few.alias("_few"), *more)
    tiles = cut_lineage(tiles)
    sums = tiles.agg(
        F.coalesce(F.sum(F.when(F.col("_few"), F.col("n_points"))), F.lit(0)).alias("rows"), F.count(F.when(~F.col("_few"), 1)).alias("many")
    ).first()
    return tiles, sums["rows"], sums["many"]


def _of(points: DataFrame, tiles: DataFrame, few: bool) -> DataFrame:
    some = tiles.where(F.col("_few") if few else ~F.col("_few")).select("tile_id")
    return points.join(some, "tile_id", "left_semi").select(points.columns)


def adaptive_downsample(points: DataFrame, most: int, start_cm: float = 4.0, ratio: float = 1.0, **options) -> DataFrame:
    """V3: downsample every tile once, with its own final size.

    Tiles of few points are searched and thinned by one call, many tiles a call: their points travel once.
    """
    tiles, rows, many = _by_size(points)
    thinning, parts = _Thinning([most], start_cm, ratio, **options), []
    if many:
        large = _of(points, tiles, False)
        parts.append(_apply_sizes(large, adaptive_sizes(large, most, start_cm, ratio, **options), ratio))
    if rows or not many:
        work = lambda table: table.take(pa.array(thinning.kept(*_numbered(table))[0]))
        small = _of(points, tiles, True) if many else points.where(F.col("tile_id").isNotNull())
        parts.append(_met(small, rows, work, points.schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _apply_sizes(points, sizes, ratio):
    whole = points.join(sizes.where(F.col("whole")), "tile_id", "left_semi")
    cut = sizes.where(~F.col("whole")).select("tile_id", (F.col("size_cm") / 100).alias("size"))
    thinned = voxel_downsample(points.join(cut.select("tile_id"), "tile_id", "left_semi"), cut, ratio)
    return whole.unionByName(thinned)


def downsample_to_caps(points: DataFrame, caps: list[int], start_cm: float = 4.0, ratio: float = 1.0, **options):
    """V4: one boolean column ``keep_<cap>`` per cap, the largest first.

    Each search starts from the size the previous cap ended with. Tiles of few points go through all caps in one call.
    """
    tiles, rows, many = _by_size(points)
    thinning, parts = _Thinning(caps, start_cm, ratio, **options), []
    names = [f"keep_{cap}" for cap in thinning.caps]

    def work(table: pa.Table) -> pa.Table:
        for name, kept in zip(names, thinning.kept(*_numbered(table), copies=True)):
            flags = np.zeros(len(table), bool)
            flags[kept] = True
            table = table.append_column(name, pa.array(flags))
        return table

    if many:
        parts.append(_flagged(_of(points, tiles, False), thinning.caps, start_cm, ratio, **options))
    if rows or not many:
        schema = StructType([*points.schema.fields, *[StructField(n, BooleanType()) for n in names]])
        small = _of(points, tiles, True) if many else points.where(F.col("tile_id").isNotNull())
        parts.append(_met(small, rows, work, schema))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _flagged(points: DataFrame, caps: list[int], start_cm: float, ratio: float, **options) -> DataFrame:
    """V4 for tiles of many points, a cap at a time."""
    start, flags = start_cm, points
    key = ["tile_id", "pid", *AXES]
    for cap in caps:
        sizes = adaptive_sizes(points, cap, start, ratio, **options)
        kept = _apply_sizes(points, sizes, ratio).select(*key).distinct().withColumn(f"keep_{cap}", F.lit(True))
        flags = written(flags.join(kept, key, "left").select(
            *flags.columns, F.coalesce(F.col(f"keep_{cap}"), F.lit(False)).alias(f"keep_{cap}")
        ))
        start = sizes
    return flags


def _digest() -> Column:
    row = F.xxhash64("pid", *AXES)
    again = F.xxhash64(F.lit("again"), "pid", *AXES)
    parts = [F.count(F.lit(1)).cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.sum(again.cast("decimal(38,0)")).cast("string")]
    return F.concat_ws("_", *parts).alias("digest")


def cloud_digests(points: DataFrame) -> DataFrame:
    """(tile_id, digest): equal for equal sets of rows (pid, x, y, z), whatever their order and partitions."""
    return points.groupBy("tile_id").agg(_digest())


def still_valid(stored: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of ``stored`` (with tile_id and digest) that were made from the clouds as they are now."""
    return stored.join(digests, ["tile_id", "digest"], "left_semi")


def downsample_with_masks(
    points: DataFrame, stored: DataFrame, most: int, start_cm: float = 4.0, ratio: float = 1.0, **options
) -> tuple[DataFrame, DataFrame]:
    """V3 with stored masks: the thinned points, and the masks of all their tiles.

    ``stored`` has one row per kept point: tile_id, cap, start_cm, ratio, digest, pid, x, y, z. A tile's mask
    counts if it was made with the same settings from the same cloud; all other tiles are thinned anew.
    The masks that come back are valid for ``points`` and may be stored in place of the old ones.
    """
    key = ["tile_id", "pid", *AXES]
    tiles, rows, many = _by_size(points, _digest())
    same = (F.col("cap") == most) & (F.col("start_cm") == float(start_cm)) & (F.col("ratio") == float(ratio))
    masks = stored.where(same).select("digest", *key)
    parts = []
    if many:
        large, digests = _of(points, tiles, False), tiles.where(~F.col("_few")).select("tile_id", "digest")
        good = written(still_valid(masks, digests).select("digest", *key).distinct())
        done = good.select("tile_id").distinct()
        reused = large.join(good.select(*key), key, "left_semi")
        fresh = adaptive_downsample(large.join(done, "tile_id", "left_anti"), most, start_cm, ratio, **options)
        parts.append(reused.unionByName(fresh).join(digests, "tile_id").select(*points.columns, F.col("digest").alias(spare(points, "_digest")[0])))
    if rows or not many:
        small = _of(points, tiles, True) if many else points.where(F.col("tile_id").isNotNull())
        parts.append(_met_with_masks(small, rows, masks, tiles.where("_few"), _Thinning([most], start_cm, ratio, **options)))
    both = written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    settings = [F.lit(most).alias("cap"), F.lit(float(start_cm)).alias("start_cm"), F.lit(float(ratio)).alias("ratio")]
    digest = F.col(spare(points, "_digest")[0]).alias("digest")
    return both.select(points.columns), both.select("tile_id", *settings, digest, "pid", *AXES)


def _met_with_masks(points: DataFrame, number: int, masks: DataFrame, tiles: DataFrame, thinning: _Thinning) -> DataFrame:
    """The kept points of tiles of few points, with their tile's digest: points, masks and digests of many tiles share a
    call, in which a mask of the tile's digest is used, and a tile without one is searched and thinned."""
    digest, kind = spare(points, "_digest", "_kind")
    own = points.columns
    types = dict(points.dtypes)
    key = [F.col(n).try_cast(types[n]).alias(n) for n in ("tile_id", "pid", *AXES)]
    stored = masks.select(*key, F.col("digest").alias(digest), F.lit(1).alias(kind)).where("pid is not null and tile_id is not null")
    known = tiles.select("tile_id", F.col("digest").alias(digest), F.lit(2).alias(kind))
    rows = points.withColumn(kind, F.lit(0))
    for df in (stored, known):
        rows = rows.unionByName(df, allowMissingColumns=True)

    def work(table: pa.Table) -> pa.Table:
        of, tile, told = table[kind].to_numpy(), *_codes_of(table, "tile_id", digest)
        now = np.full(tile.max() + 1, -1, np.int64)
        now[tile[of == 2]] = told[of == 2]
        good = np.flatnonzero((of == 1) & (told == now[tile]))
        done = np.zeros(len(now), bool)
        done[tile[good]] = True
        asked = np.flatnonzero((of == 0) & done[tile])
        kept = [asked[_among(table, tile, asked, good)]]
        fresh = np.flatnonzero((of == 0) & ~done[tile])
        if len(fresh):
            some = table.select(["tile_id", "pid", *AXES]).take(pa.array(fresh))
            kept.append(fresh[thinning.kept(*_numbered(some))[0]])
        found = np.concatenate(kept)
        digests = table[digest].take(pa.array(np.flatnonzero(of == 2)))
        at = np.zeros(len(now), np.int64)
        at[tile[of == 2]] = np.arange(len(digests))
        return table.select(own).take(pa.array(found)).append_column(digest, digests.take(pa.array(at[tile[found]])))

    return _met(rows, number, work, StructType([*points.schema.fields, StructField(digest, StringType())]))


def _codes_of(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Each column's values as numbers, equal for equal values."""
    return [pc.dictionary_encode(table[n], null_encoding="encode").combine_chunks().indices.to_numpy().astype(np.int64) for n in names]


def _among(table: pa.Table, tile: np.ndarray, asked: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Which of the rows ``asked`` equal a row of ``given`` in tile, pid and coordinates."""
    rows = np.concatenate([asked, given])
    some = table.select(["pid", *AXES]).take(pa.array(rows))
    keys = [tile[rows], _numbers(some["pid"])[0], *(some[a].to_numpy() for a in AXES)]
    by = np.lexsort(keys[::-1])
    run = np.cumsum(np.concatenate([[True], np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)])[: len(by)])
    held = np.zeros(len(rows) + 1, bool)
    held[run[by >= len(asked)]] = True
    out = np.zeros(len(rows), bool)
    out[by] = held[run]
    return out[: len(asked)]


def octree_lowest(points: DataFrame, depth: int) -> DataFrame:
    """V5: the lowest point of every octant at a depth of the cloud's box.

    Octants are half-open, the outer faces closed; ties go to the smaller (x, y, pid).
    """
    n = 1 << depth
    box = points.groupBy("tile_id").agg(
        *[F.min(a).alias(f"_{a}0") for a in AXES], *[F.max(a).alias(f"_{a}1") for a in AXES]
    )
    rows = points.join(box, "tile_id")
    codes: list[Column] = []
    for a in AXES:
        share = F.try_divide(F.col(a) - F.col(f"_{a}0"), F.col(f"_{a}1") - F.col(f"_{a}0"))
        codes.append(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * n), F.lit(n - 1)).alias(f"_o{a}"))
    order = F.struct("z", "x", "y", "pid")
    best = rows.groupBy("tile_id", *codes).agg(F.min_by(F.struct(*points.columns), order).alias("_p"))
    return best.select("_p.*")
