"""Exact nearest neighbours as joins, without ever pairing all points of a tile.

Both clouds are summarised by an octree of cells with tight boxes (a roll-up of
partial aggregates). Pairs of cells go down level by level: for every query cell
the distance that surely holds k targets is known from the boxes, and target
cells further away than that are dropped. What remains per query cell is a short
list of leaf cells, and only the points of those are compared. Cells split by
their own count, so a crowded corner or a giant tile only makes more cells; no
step works on a tile as a whole.

Groups of few points on both sides need no tree: their points meet once, by an equi-join on a bucket
of groups, and are compared group by group in blocks of bounded size. Which groups those are is told by their counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tileloom.operators.ranks import spare
from tileloom.session import cut_lineage, written

AXES = ("x", "y", "z")
LEAF = 64
MAX_DEPTH = 16
#: A group with at most this many leaves' worth of points on either side is compared without a tree.
LEAVES_COMPARED = 32
#: Distances held at once in that comparison, and its largest extent (squares stay finite).
BLOCK, WIDEST = 1 << 14, 1e100
#: Rows of both sides that one call of that comparison gets, in expectation: many groups of few points.
ROWS_MET = 1 << 15
#: Rows of a partition of tiles whose both directions are compared by one call, in expectation.
ROWS_DEALT = 1 << 16


def _frames(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """Origin and side of the cube around both clouds of a group, and the targets' number."""
    both = a.select(*group, *AXES, F.lit(0).alias("_t")).unionByName(
        b.select(*group, *AXES, F.lit(1).alias("_t"))
    )
    ends = both.groupBy(*group).agg(
        *[F.min(c).alias(f"_{c}0") for c in AXES], *[F.max(c).alias(f"_{c}1") for c in AXES],
        F.sum("_t").alias("_targets"), F.sum(1 - F.col("_t")).alias("_queries"),
    )
    side = F.greatest(*[F.col(f"_{c}1") - F.col(f"_{c}0") for c in AXES])
    return cut_lineage(ends.select(
        *group, *[f"_{c}0" for c in AXES], F.when(side > 0, side).otherwise(F.lit(1.0)).alias("_side"),
        "_targets", "_queries",
    ))


def _node(level: Column, depth: int, ix: Column, iy: Column, iz: Column) -> Column:
    n = 1 << depth
    return ((level * n + ix) * n + iy) * n + iz


def _coded(points: DataFrame, frames: DataFrame, group: list[str], depth: int) -> DataFrame:
    n = 1 << depth
    out = points.join(frames, group)
    for c in AXES:
        share = (F.col(c) - F.col(f"_{c}0")) / F.col("_side") * F.lit(float(n))
        out = out.withColumn(f"_i{c}", F.least(F.floor(share), F.lit(n - 1)))
    return out.drop("_side", "_targets", "_queries", *[f"_{c}0" for c in AXES])


def _tree(coded: DataFrame, group: list[str], depth: int, leaf: int) -> DataFrame:
    """All nodes of all levels: id, parent, count, leaf flag and tight box; written once."""
    idx = [f"_i{c}" for c in AXES]
    cells = coded.groupBy(*group, *idx).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(c).alias(f"_lo{c}") for c in AXES], *[F.max(c).alias(f"_hi{c}") for c in AXES],
    )
    levels = cells.withColumn(
        "_level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth).cast("long")))
    )
    up = F.lit(depth) - F.col("_level")
    # floor of a non-negative index by a power of two
    part = [F.floor(F.col(i) / F.pow(F.lit(2.0), up)).cast("long").alias(i) for i in idx]
    boxes = [f"_{e}{c}" for e in ("lo", "hi") for c in AXES]
    nodes = levels.select(*group, "_level", *part, "_n", *boxes)
    nodes = nodes.groupBy(*group, "_level", *idx).agg(
        F.sum("_n").alias("_n"),
        *[F.min(f"_lo{c}").alias(f"_lo{c}") for c in AXES],
        *[F.max(f"_hi{c}").alias(f"_hi{c}") for c in AXES],
    )
    half = [F.floor(F.col(i) / 2).cast("long") for i in idx]
    return cut_lineage(nodes.select(
        *group, "_level", *idx, "_n", *boxes,
        _node(F.col("_level"), depth, *[F.col(i) for i in idx]).alias("_id"),
        _node(F.col("_level") - 1, depth, *half).alias("_parent"),
        ((F.col("_n") <= leaf) | (F.col("_level") == depth)).alias("_leaf"),
    ))


def _steps(nodes: DataFrame, key: list[str]) -> DataFrame:
    """One descent step: from a node to its children, or from a leaf to itself."""
    boxes = [f"_{e}{c}" for e in ("lo", "hi") for c in AXES]
    splits = nodes.where(~F.col("_leaf")).select(*key, F.col("_id").alias("_parent"))
    down = nodes.where(F.col("_level") > 0).join(splits, [*key, "_parent"], "left_semi")
    stay = nodes.where(F.col("_leaf")).withColumn("_parent", F.col("_id"))
    return cut_lineage(down.unionByName(stay).select(*key, "_parent", "_id", "_n", *boxes))


def _steps_of(steps: DataFrame, group: list[str], tag: str) -> DataFrame:
    boxes = [f"_{e}{c}" for e in ("lo", "hi") for c in AXES]
    return steps.where(F.col("_t") == tag).select(
        *group, F.col("_parent").alias(tag), F.col("_id").alias(f"{tag}_next"),
        *[F.col(n).alias(f"{tag}{n}") for n in ("_n", *boxes)],
    )


def _leaf_of_cell(nodes: DataFrame, key: list[str], depth: int) -> DataFrame:
    """Deepest cell to the leaf it belongs to: the first leaf on the way from the root."""
    idx = [f"_i{c}" for c in AXES]
    cells = nodes.where(F.col("_level") == depth).select(*key, *idx)
    ways = cells.withColumn("_level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(depth).cast("long"))))
    shift = F.pow(F.lit(2.0), F.lit(depth) - F.col("_level"))
    part = [F.floor(F.col(i) / shift).cast("long") for i in idx]
    ways = ways.withColumn("_id", _node(F.col("_level"), depth, *part))
    leaves = nodes.where(F.col("_leaf")).select(*key, "_id")
    return ways.join(leaves, [*key, "_id"]).groupBy(*key, *idx).agg(
        F.min_by("_id", "_level").alias("_own")
    )


def _box_distance(far: bool) -> Column:
    total = None
    for c in AXES:
        left = F.col(f"a_lo{c}") - F.col(f"b_hi{c}")
        right = F.col(f"b_lo{c}") - F.col(f"a_hi{c}")
        if far:
            gap = F.greatest(F.abs(left), F.abs(right))
        else:
            gap = F.greatest(left, right, F.lit(0.0))
        total = gap * gap if total is None else total + gap * gap
    return total


def _depth_for(rows: int, leaf: int) -> int:
    return max(1, min(MAX_DEPTH, math.ceil(math.log(max(rows / leaf, 1.0), 4))))


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    k: int = 1,
    group: list[str] | None = None,
    exclude_self: bool = False,
    leaf: int = LEAF,
) -> DataFrame:
    """The k nearest targets of every query point inside its group.

    Both frames need ``pid, x, y, z`` and the group columns, with one row per point of
    a group (equal rows count once); other query columns are kept. Adds ``n_pid, n_x, n_y, n_z, d2`` and, for k > 1, ``rank``. Ties go to the
    smaller (x, y, z, pid). With ``exclude_self`` a point is not its own neighbour.
    """
    group = group or ["tile_id"]
    frames = _frames(queries, targets, group)
    plain = {t for df in (queries, targets) for n, t in df.dtypes if n in AXES} == {"double"}
    most = LEAVES_COMPARED * leaf if plain else 0
    few = (F.greatest("_queries", "_targets") <= most) & (F.col("_side") < WIDEST)
    sorts = frames.where((F.col("_queries") > 0) & (F.col("_targets") > 0)).agg(
        F.count(F.when(few, 1)).alias("few"), F.count(F.when(~few, 1)).alias("many"),
        F.coalesce(F.sum(F.when(few, F.col("_queries") + F.col("_targets"))), F.lit(0)).alias("rows"),
    ).first()
    if not sorts["many"]:
        return _compared(queries, targets, k, group, exclude_self, sorts["rows"])
    if not sorts["few"]:
        return _descended(queries, targets, frames, k, group, exclude_self, leaf)
    small, large = frames.where(few).select(*group), frames.where(~few)
    of = lambda df, some: df.join(some.select(*group), group, "left_semi").select(df.columns)
    return _compared(of(queries, small), of(targets, small), k, group, exclude_self, sorts["rows"]).unionByName(
        _descended(of(queries, large), of(targets, large), large, k, group, exclude_self, leaf)
    )


def _best(a: np.ndarray, b: np.ndarray, pid_a: np.ndarray, pid_b: np.ndarray, k: int, exclude_self: bool):
    """Rows of ``a``, rows of ``b``, ranks and squared distances of the k nearest; ties to the earlier row of ``b``."""
    found, step = [], max(1, BLOCK // max(len(b), 1))
    # Two buffers small enough for a core's cache take all blocks.
    whole, part = np.empty((min(step, len(a)), len(b))), np.empty((min(step, len(a)), len(b)))
    of_b = np.ascontiguousarray(b.T)
    for start in range(0, len(a), step):
        rows = np.arange(start, min(start + step, len(a)))
        d2, gap = whole[: len(rows)], part[: len(rows)]
        for c, out in enumerate((d2, gap, gap)):
            np.subtract(a[rows, c, None], of_b[c], out=out)
            np.multiply(out, out, out=out)
            if c:
                np.add(d2, gap, out=d2)
        if exclude_self:
            d2[(d2 == 0) & (pid_a[rows, None] == pid_b[None, :])] = np.inf
        at = np.arange(len(rows))
        order = np.argsort(d2, axis=1, kind="stable") if k > LEAVES_COMPARED else None
        for rank in range(min(k, len(b))):
            pick = d2.argmin(axis=1) if order is None else order[:, rank]
            least = d2[at, pick]
            ok = least < np.inf
            found.append((rows[ok], pick[ok], np.full(ok.sum(), rank + 1), least[ok]))
            if order is None:
                d2[at, pick] = np.inf
    return [np.concatenate(part) for part in zip(*found)]


def _numbers(*pids: pa.ChunkedArray) -> list[np.ndarray]:
    """Ids as numbers of the same order."""
    if all(pa.types.is_integer(p.type) and not p.null_count for p in pids):
        return [p.to_numpy() for p in pids]
    every = pa.concat_arrays([chunk for p in pids for chunk in p.chunks])
    ranks = pc.rank(every, null_placement="at_start", tiebreaker="dense").to_numpy()
    return np.split(ranks, np.cumsum([len(p) for p in pids])[:-1])


def _codes(left: list[pa.ChunkedArray], right: list[pa.ChunkedArray]) -> list[np.ndarray]:
    """The groups of the rows of two tables as numbers, equal for equal groups."""
    codes = np.zeros(len(left[0]) + len(right[0]), np.int64)
    for some in zip(left, right):
        every = pa.concat_arrays([chunk for c in some for chunk in c.chunks])
        if pa.types.is_floating(every.type):
            every = pc.add(every, 0.0)
        own = every.dictionary_encode().indices.to_numpy().astype(np.int64)
        codes = np.unique(codes * (own.max() + 1) + own, return_inverse=True)[1]
    return np.split(codes, [len(left[0])])


def _compared(
    queries: DataFrame, targets: DataFrame, k: int, group: list[str], exclude_self: bool, rows: int
) -> DataFrame:
    """The nearest targets in groups of few points: a group's points meet in one comparison.

    Many groups share a bucket, so that a call costs little beside its comparisons; ``rows`` is the
    number of rows of both frames, and a bucket holds about ``ROWS_MET`` of them.
    """
    filled = lambda names: " and ".join(f"`{n}` is not null" for n in names)
    plus = lambda df, key: [F.col(c) + F.lit(0.0) if t in ("double", "float") else F.col(c) for c, t in df.select(*key).dtypes]
    at = spare(queries, "_bucket")[0]
    buckets = F.lit(max(1, math.ceil(rows / ROWS_MET)))

    def dealt(df, key, spot):
        # Dealt first, so that equal rows meet without another shuffle.
        kept = df.where(filled([*key, *spot])).withColumn(at, F.pmod(F.xxhash64(*plus(df, key)), buckets))
        return kept.repartition(at).distinct()

    names = [f"n_{c}" for c in (*AXES, "pid")]
    own = [f"_g{i}" for i in range(len(group))]
    answers = targets.select(
        *[F.col(g).alias(o) for g, o in zip(group, own)], *[F.col(c).alias(f"n_{c}") for c in (*AXES, "pid")]
    )
    a, b = dealt(queries, group, AXES), dealt(answers, own, names[:3])
    kept, ranked = queries.columns, k > 1
    fields = [*[a.schema[n] for n in kept], StructField("d2", DoubleType()), *[b.schema[n] for n in names]]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + [StructField("rank", IntegerType())] * ranked)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            spots = [np.column_stack([t[c].to_numpy() for c in some]) for t, some in ((left, AXES), (right, names[:3]))]
            pid_a, pid_b = _numbers(left["pid"], right["n_pid"])
            code_a, code_b = _codes([left[g] for g in group], [right[o] for o in own])
            by_a, by_b = np.argsort(code_a, kind="stable"), np.lexsort((pid_b, *(spots[1][:, c] for c in (2, 1, 0)), code_b))
            there = np.intersect1d(code_a, code_b)
            ends = [np.searchsorted(code[by], there, side) for code, by in ((code_a, by_a), (code_b, by_b)) for side in ("left", "right")]
            for a0, a1, b0, b1 in zip(*ends):
                mine, other = by_a[a0:a1], by_b[b0:b1]
                m, o, rank, d2 = _best(spots[0][mine], spots[1][other], pid_a[mine], pid_b[other], k, exclude_self)
                found.append((mine[m], other[o], rank, d2))
        if not found:
            columns = {n: left[n].slice(0, 0) for n in kept} | {"d2": pa.array([], pa.float64())}
            columns |= {n: right[n].slice(0, 0) for n in names}
            return pa.table(columns | ({"rank": pa.array([], pa.int32())} if ranked else {}))
        mine, other, rank, d2 = (np.concatenate(part) for part in zip(*found))
        met, near = left.take(pa.array(mine)), right.take(pa.array(other))
        columns = {n: met[n] for n in kept} | {"d2": pa.array(d2)} | {n: near[n] for n in names}
        return pa.table(columns | ({"rank": pa.array(rank.astype("int32"))} if ranked else {}))

    return a.groupBy(at).cogroup(b.groupBy(at)).applyInArrow(compare, schema)


def _best_both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``a`` the nearest of ``b`` and the squared distance, then the other way; ties to the earlier row."""
    step = max(1, BLOCK // len(b))
    whole, part = np.empty((min(step, len(a)), len(b))), np.empty((min(step, len(a)), len(b)))
    of_b = np.ascontiguousarray(b.T)
    pick_a, least_a = np.empty(len(a), np.int64), np.empty(len(a))
    pick_b, least_b = np.zeros(len(b), np.int64), np.full(len(b), np.inf)
    for start in range(0, len(a), step):
        rows = a[start : start + step]
        d2, gap = whole[: len(rows)], part[: len(rows)]
        for c, out in enumerate((d2, gap, gap)):
            np.subtract(rows[:, c, None], of_b[c], out=out)
            np.multiply(out, out, out=out)
            if c:
                np.add(d2, gap, out=d2)
        near = d2.argmin(axis=1)
        pick_a[start : start + step], least_a[start : start + step] = near, d2[np.arange(len(rows)), near]
        least = d2.min(axis=0)
        closer = np.flatnonzero(least < least_b)
        pick_b[closer], least_b[closer] = start + d2[:, closer].argmin(axis=0), least[closer]
    return pick_a, least_a, pick_b, least_b


def _compared_both(points: DataFrame, models: list[str], carry: list[str], rows: int, want: list[str]) -> DataFrame:
    """:func:`both_ways` for tiles of few points: all clouds of many tiles travel once and share a call,
    and a pair of clouds' distances serve both directions. Only the columns ``want`` are made."""
    kept = points.where(" and ".join(f"`{n}` is not null" for n in ("tile_id", *AXES)))
    (which,) = spare(points, "_which")
    # A cloud is its place among the models; the cloud that all are compared with comes last.
    place = F.lit(len(models))
    for i, m in enumerate(models):
        place = F.when(F.col("cloud") == m, F.lit(i)).otherwise(place)
    kept = kept.select(
        *[(F.col(c) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in kept.select("tile_id", "pid", *AXES).dtypes],
        *carry, place.cast("int").alias(which),
    )
    own = ["tile_id", "pid", *AXES, *carry]
    near = [n for n in own if n != "tile_id"]
    fields = [kept.schema[n] for n in own] + [StructField(f"n_{n}", kept.schema[n].dataType) for n in near]
    fields += [StructField("side", StringType()), StructField("d2", DoubleType()), StructField("n_shared", LongType())]
    fields += [StructField("cloud", StringType()), StructField("d1", DoubleType())]

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        spots = np.column_stack([table[c].to_numpy() for c in AXES])
        (pid,), kind = _numbers(table["pid"]), table[which].to_numpy().astype(np.int64)
        code = _codes([table["tile_id"]], [table["tile_id"].slice(0, 0)])[0]
        cloud = (len(models) + 1) * code + kind
        order = np.lexsort((spots[:, 0], cloud))
        # Only points that share a cloud and an x need the other keys.
        same = (cloud[order][1:] == cloud[order][:-1]) & (spots[order, 0][1:] == spots[order, 0][:-1])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        some = order[tied]
        order[tied] = some[np.lexsort((pid[some], *(spots[some, c] for c in (2, 1, 0)), cloud[some]))]
        # Equal points count once.
        keys = np.column_stack([spots[order], cloud[order]])
        again = (keys[1:] == keys[:-1]).all(axis=1) & (pid[order][1:] == pid[order][:-1])
        order = order[np.concatenate([[True], ~again])]
        cloud, spots = cloud[order], spots[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cloud)) + 1, [len(cloud)]])
        held = dict(zip(cloud[starts[:-1]].tolist(), zip(starts[:-1].tolist(), starts[1:].tolist())))
        found = []
        for at, (a0, a1) in held.items():
            tile, model = divmod(at, len(models) + 1)
            b0, b1 = held.get((tile + 1) * (len(models) + 1) - 1, (0, 0))
            if model < len(models) and b0 < b1:
                pick_a, least_a, pick_b, least_b = _best_both(spots[a0:a1], spots[b0:b1])
                shared = np.bincount(pick_a, minlength=b1 - b0)[pick_a], np.bincount(pick_b, minlength=a1 - a0)[pick_b]
                found.append((np.concatenate([np.arange(a0, a1), np.arange(b0, b1)]), np.concatenate([b0 + pick_a, a0 + pick_b]),
                              np.concatenate([least_a, least_b]), np.concatenate(shared),
                              np.repeat([1, 0], [a1 - a0, b1 - b0]), np.full(a1 - a0 + b1 - b0, model)))
        if found:
            row, other, d2, shared, ahead, model = (np.concatenate(part) for part in zip(*found))
        else:
            row, other, shared, ahead, model = (np.zeros(0, np.int64) for _ in range(5))
            d2 = np.zeros(0)
        met, theirs = pa.array(order[row]), pa.array(order[other])
        made = {n: lambda n=n: table[n].take(met) for n in own} | {f"n_{n}": lambda n=n: table[n].take(theirs) for n in near}
        made |= {"d2": lambda: pa.array(d2), "n_shared": lambda: pa.array(shared.astype(np.int64))}
        made["side"] = lambda: pa.array(["ba", "ab"]).take(pa.array(ahead.astype(np.int8)))
        made["cloud"] = lambda: pa.array(models, pa.string()).take(pa.array(model))
        made["d1"] = lambda: pa.array(sum((np.abs(spots[row, c] - spots[other, c]) for c in (1, 2)), np.abs(spots[row, 0] - spots[other, 0])))
        return pa.table({n: made[n]() for n in want})

    kinds = {f.name: f.dataType for f in fields}
    # One call a partition, whose number grows with the rows.
    calls = lambda batches: (batch for table in [list(batches)] if table for batch in compare(pa.Table.from_batches(table)).to_batches())
    dealt = kept.repartition(max(1, math.ceil(rows / ROWS_DEALT)), "tile_id")
    return dealt.mapInArrow(calls, StructType([StructField(n, kinds[n]) for n in want]))


def _descended(
    queries: DataFrame, targets: DataFrame, frames: DataFrame, k: int, group: list[str], exclude_self: bool, leaf: int
) -> DataFrame:
    """The nearest targets by a descent of both trees."""
    need = k + 1 if exclude_self else k
    # Copies of one coordinate beyond the first few can never be reported.
    spot = [*group, *AXES]
    b = targets.select(*spot, "pid")
    if need == 1:
        b = b.groupBy(*spot).agg(F.min("pid").alias("pid"))
    else:
        copies = Window.partitionBy(*spot).orderBy("pid")
        b = b.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= need).drop("_c")
    size = frames.agg(F.max("_targets").alias("most"), F.sum("_targets").alias("total")).first()
    depth = _depth_for(size["most"] or 0, leaf)
    key = [*group, "_t"]
    tagged = queries.select(*group, F.lit("a").alias("_t"), *AXES).unionByName(
        b.select(*group, F.lit("b").alias("_t"), *AXES)
    )
    while True:
        nodes = _tree(_coded(tagged, frames, group, depth), key, depth, leaf)
        deepest = nodes.where((F.col("_level") == depth) & (F.col("_t") == "b"))
        fullest = deepest.agg(F.max("_n")).first()[0] or 0
        if fullest <= 8 * max(leaf, need) or depth >= MAX_DEPTH:
            break
        depth = min(MAX_DEPTH, depth + 3)

    steps = _steps(nodes, key)
    step_a, step_b = _steps_of(steps, group, "a"), _steps_of(steps, group, "b")
    roots = nodes.where(F.col("_level") == 0).groupBy(*group).agg(
        F.max(F.when(F.col("_t") == "a", F.col("_id"))).alias("a"),
        F.max(F.when(F.col("_t") == "b", F.col("_id"))).alias("b"),
    )
    pairs = roots.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    by_query = Window.partitionBy(*group, "a_next")
    boxes_b = [f"b_{e}{c}" for e in ("lo", "hi") for c in AXES]
    for _ in range(depth):
        wide = pairs.select(*group, "a", "b").join(step_a, [*group, "a"]).join(step_b, [*group, "b"])
        wide = wide.withColumn("_near", _box_distance(False)).withColumn("_far", _box_distance(True))
        held = F.sum("b_n").over(by_query.orderBy("_far", "b_next"))
        wide = wide.withColumn("_held", held)
        enough = F.min(F.when(F.col("_held") >= need, F.col("_far"))).over(by_query)
        wide = wide.withColumn("_limit", enough * F.lit(1.0 + 1e-9) + F.lit(1e-18))
        pairs = wide.where(F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit"))).select(
            *group, F.col("a_next").alias("a"), F.col("b_next").alias("b"), "_limit", *boxes_b
        )

    cell = [*group, *[f"_i{c}" for c in AXES]]
    owner = _leaf_of_cell(nodes, key, depth)

    def with_leaf(points, tag):
        own = owner.where(F.col("_t") == tag).drop("_t").withColumnRenamed("_own", tag)
        return _coded(points, frames, group, depth).join(own, cell).drop(*[f"_i{c}" for c in AXES])

    # Dealt by leaf, as the join below needs it: comparing is spread whatever the input's splits.
    a_points = with_leaf(queries, "a").repartition(*group, "a")
    # A leaf's targets travel as one short array: a query meets a row per leaf, not per target.
    names = [*[f"n_{c}" for c in AXES], "n_pid"]
    b_leaves = (
        with_leaf(b, "b")
        .groupBy(*group, "b")
        .agg(F.collect_list(F.struct(*[F.col(c).alias(f"n_{c}") for c in AXES], F.col("pid").alias("n_pid"))).alias("_pts"))
    )
    away = None
    for c in AXES:
        gap = F.greatest(F.col(f"b_lo{c}") - F.col(c), F.col(c) - F.col(f"b_hi{c}"), F.lit(0.0))
        away = gap * gap if away is None else away + gap * gap
    near = a_points.join(pairs, [*group, "a"]).where(
        F.col("_limit").isNull() | (away <= F.col("_limit"))
    )
    kept = queries.columns
    met = near.select(*kept, "b").join(b_leaves, [*group, "b"])

    def measured(p):
        dx, dy, dz = (F.col(c) - p[f"n_{c}"] for c in AXES)
        d2 = dx * dx + dy * dy + dz * dz
        return F.struct(d2.alias("d2"), *[p[n].alias(n) for n in names])

    def another(m):
        return ~((m["n_pid"] == F.col("pid")) & (m["d2"] == 0))

    measures = F.transform("_pts", measured)
    if exclude_self:
        measures = F.filter(measures, another)
    if k == 1:
        best = met.select(*kept, F.array_min(measures).alias("_m")).where(F.col("_m").isNotNull())
        return best.groupBy(*kept).agg(F.min("_m").alias("_m")).select(*kept, "_m.*")
    # Each leaf offers at most its k best; the ranking sees only those.
    offers = met.select(*kept, F.explode(F.slice(F.array_sort(measures), 1, k)).alias("_m")).select(*kept, "_m.*")
    w = Window.partitionBy(*kept).orderBy("d2", *names)
    return offers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cross_nearest(points: DataFrame, a: str, b: str, leaf: int = LEAF) -> DataFrame:
    """K3: for every point of cloud ``a`` the nearest point of cloud ``b`` in its tile."""
    base = points.select("tile_id", "cloud", "pid", *AXES)
    left = base.where(F.col("cloud") == a).drop("cloud")
    right = base.where(F.col("cloud") == b).drop("cloud")
    return nearest(left, right, leaf=leaf)


def both_ways(
    points: DataFrame, a: str | list[str], b: str, leaf: int = LEAF, want: list[str] | None = None, carry: list[str] | None = None
) -> DataFrame:
    """K3 in both directions, in one pass: ``side`` is 'ab' (points of a) or 'ba'.

    ``want`` names the columns returned beside tile_id and side, all by default; a caller that names the few it
    reads moves less. Besides those of :func:`nearest` there are ``n_shared``, the number of points of the side with
    the same nearest point, and ``d1``, the Manhattan distance to it. The columns ``carry`` of a point go along, those
    of its neighbour as ``n_<name>``; they must be the same in equal points (tile_id, cloud, pid, x, y, z).
    With a list of clouds ``a`` each of them is compared with ``b``, and ``cloud`` names the one of a row; the points of
    ``b`` travel once for all of them.
    """
    carry = carry or []
    models = [a] if isinstance(a, str) else list(dict.fromkeys(a))
    key = ["tile_id", "side"] if isinstance(a, str) else ["tile_id", "cloud", "side"]
    base = points.select("tile_id", "cloud", "pid", *AXES, *carry).where(F.col("cloud").isin(*models, b))
    mine = F.col("cloud").isin(models)
    names = want or ["pid", *AXES, "d2", *[f"n_{c}" for c in (*AXES, "pid")], *carry, *[f"n_{c}" for c in carry]]
    want = [*key, *names] if want else [*key[:-1], *names[:4], "side", *names[4:]]

    def by_sides(some: DataFrame) -> DataFrame:
        every = F.explode(F.array(*[F.lit(m) for m in models]))
        sides = [some.where(mine), some.where(F.col("cloud") == b).withColumn("cloud", every)]
        both = lambda first, second: sides[0].withColumn("side", F.lit(first)).unionByName(sides[1].withColumn("side", F.lit(second)))
        asks, answers = (df if "cloud" in key else df.drop("cloud") for df in (both("ab", "ba"), both("ba", "ab")))
        found = nearest(asks, answers.drop(*carry), group=key, leaf=leaf)
        match = [*key, *[f"n_{c}" for c in (*AXES, "pid")]]
        if carry:
            theirs = answers.select(*key, *[F.col(c).alias(f"n_{c}") for c in (*AXES, "pid", *carry)])
            found = found.join(theirs.dropDuplicates(match), match)
        if "d1" in want:
            gaps = [F.abs(F.col(c) - F.col(f"n_{c}")) for c in AXES]
            found = found.withColumn("d1", gaps[0] + gaps[1] + gaps[2])
        if "n_shared" in want:
            # Written once: the descent is long, and its rows are read twice.
            found = written(found.select(*dict.fromkeys([*match, *[n for n in want if n != "n_shared"]])))
            found = found.join(found.groupBy(*match).agg(F.count(F.lit(1)).alias("n_shared")), match)
        return found.select(*want)

    if {t for n, t in base.dtypes if n in AXES} != {"double"} or b in models:
        return by_sides(base)
    side = F.greatest(*[F.max(c) - F.min(c) for c in AXES])
    sizes = [F.count(F.when(F.col("cloud") == c, 1)) for c in (*models, b)]
    few = (F.greatest(*sizes) <= LEAVES_COMPARED * leaf) & (F.coalesce(side, F.lit(0.0)) < WIDEST)
    # A tile with one cloud has no neighbours.
    met = (F.count(F.when(mine, 1)) > 0) & (sizes[-1] > 0)
    tiles = base.groupBy("tile_id").agg(few.alias("_few"), F.count(F.lit(1)).alias("_n"), met.alias("_both"))
    tiles = cut_lineage(tiles.where("_both").drop("_both"))
    sorts = tiles.agg(
        F.count(F.when(F.col("_few"), 1)).alias("few"), F.count(F.when(~F.col("_few"), 1)).alias("many"),
        F.coalesce(F.sum(F.when(F.col("_few"), F.col("_n"))), F.lit(0)).alias("rows"),
    ).first()
    if not sorts["many"]:
        return _compared_both(base, models, carry, sorts["rows"], want)
    if not sorts["few"]:
        return by_sides(base)
    of = lambda some: base.join(tiles.where(some).select("tile_id"), "tile_id", "left_semi").select(base.columns)
    met = _compared_both(of(F.col("_few")), models, carry, sorts["rows"], want)
    return met.unionByName(by_sides(of(~F.col("_few"))))


def knn_graph(points: DataFrame, k: int = 16, count_self: bool = False) -> DataFrame:
    """K1/K2: directed edges to the k nearest other points of the tile.

    With ``count_self`` the point itself is one of the k and then left out, so k - 1
    real neighbours remain.
    """
    real = k - 1 if count_self else k
    base = points.select("tile_id", "pid", *AXES)
    found = nearest(base, base, k=real, exclude_self=True)
    if real == 1:
        found = found.withColumn("rank", F.lit(1))
    return found


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, each once."""
    swapped = edges.select("tile_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("tile_id", "src", "dst").unionByName(swapped).distinct()


def edge_table(points: DataFrame, k: int) -> DataFrame:
    # Written once: the search reads its points several times, and they may be long to make.
    graph = knn_graph(cut_lineage(points.select("tile_id", "pid", *AXES)), k).select("tile_id", F.col("pid").alias("src"), F.col("n_pid").alias("dst"))
    return undirected(graph).select("tile_id", F.lit(k).alias("k"), "src", "dst")


def graph_for(stored: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The stored graph of the wanted k, else of the nearest stored k, else computed."""
    have = stored.select("tile_id", "k").distinct()
    chosen = have.groupBy("tile_id").agg(F.min_by("k", F.struct(F.abs(F.col("k") - k), "k")).alias("k"))
    kept = stored.join(chosen, ["tile_id", "k"], "left_semi")
    missing = points.join(chosen, "tile_id", "left_anti")
    return kept.unionByName(edge_table(missing, k).withColumn("k", F.lit(k)))


def repulsion(points: DataFrame, k: int = 5, h: float = 0.03, eps: float = 1e-8) -> DataFrame:
    """K5: mean over the k nearest of relu(h - d) * exp(-d^2 / h^2) per tile."""
    d = F.sqrt(F.col("d2") + F.lit(eps))
    push = F.greatest(F.lit(h) - d, F.lit(0.0)) * F.exp(-d * d / F.lit(h * h))
    return knn_graph(points, k).groupBy("tile_id").agg(F.avg(push).alias("repulsion"))


def patch_transfer(
    points: DataFrame, patches: DataFrame, radius: float, temperature: float, width: float | None = None
) -> DataFrame:
    """Patch values to points, weight exp(-d / T) within the radius, normalised.

    ``patches`` has tile_id, px, py, v. Points and patches meet on a bucket of the
    radius; a point whose weights sum to at most 1e-6 gets 0.
    """
    r = F.lit(float(radius))
    p = points.select("tile_id", "pid", "x", "y", F.floor(F.col("x") / r).alias("_bx"), F.floor(F.col("y") / r).alias("_by"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    q = patches.withColumn("_ox", F.explode(around)).withColumn("_oy", F.explode(around)).select(
        "tile_id", "px", "py", "v",
        (F.floor(F.col("px") / r) + F.col("_ox")).alias("_bx"), (F.floor(F.col("py") / r) + F.col("_oy")).alias("_by"),
    )
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    w = F.exp(-F.col("_d") / F.lit(float(temperature)))
    pairs = p.join(q, ["tile_id", "_bx", "_by"], "left").withColumn("_d", d)
    inside = F.col("_d") <= r
    found = pairs.groupBy("tile_id", "pid", "x", "y").agg(
        F.coalesce(F.sum(F.when(inside, w)), F.lit(0.0)).alias("_w"),
        F.coalesce(F.sum(F.when(inside, w * F.col("v"))), F.lit(0.0)).alias("_wv"),
    )
    value = F.when(F.col("_w") > 1e-6, F.try_divide("_wv", "_w")).otherwise(F.lit(0.0))
    return found.select("tile_id", "pid", "x", "y", value.alias("v"))
