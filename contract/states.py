"""G1 and G11 with a caller's statistic, S4, S5 and S11 over whole tables."""

import uuid

from pyspark.sql import functions as F

from contract.base import POINTS, draw, query, r
from tileloom import bindings as b
from tileloom.operators import cell_states as cs, grid as g
from tileloom.session import ensure_checkpoint_dir
from tileloom.sources import attempts as at, tiles as tl

BOX = (0, 0, 10, 10)
KEYS = ["tile_id", "cloud", "row", "col"]
CELLS = """cells as (select *, least(cast(trunc(y / 2.5) as int), 3) as row, least(cast(trunc(x / 2.5) as int), 3) as col from points)"""
_TRIMMED = """k as (select *, row_number() over (partition by tile_id, cloud, row, col order by {v}) as rn, count(*) over (partition by tile_id, cloud, row, col) as n from cells)
select tile_id, cloud, row, col, {out} from k where rn > trunc(n * {share}::double) and rn <= n - trunc(n * {share}::double) group by all"""


def _cells(spark, d):
    return g.with_cells(b.points(spark, d), g.fixed_box(*BOX), 2.5)


@query("cell_trimmed_mean", f"with {POINTS}, {CELLS}, {_TRIMMED.format(v='z', out=r('avg(z)', 'v'), share=0.1)}")
def cell_trimmed_mean(spark, d):
    return cs.cell_statistic(_cells(spark, d), cs.TrimmedMean(0.1), "z", KEYS)


@query("cell_layer_shares", f"""with {POINTS}, {CELLS},
n as (select tile_id, cloud, row, col, [count(*) filter (where z < 2), count(*) filter (where z >= 2 and z < 5), count(*) filter (where z >= 5 and z < 12), count(*) filter (where z >= 12)] as c, count(*) as n from cells group by all)
select tile_id, cloud, row, col, cast(i as int) as band, {r('c[i + 1] / n::double', 'v')} from n, (select unnest(range(4)) as i)""")
def cell_layer_shares(spark, d):
    return cs.cell_bands(_cells(spark, d), cs.LayerShares([2.0, 5.0, 12.0]), "z", KEYS)


@query("raster_array_trimmed", f"""with {POINTS}, e as (select tile_id, cloud, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points group by all),
i as (select p.*, cast(round_even((x1 - x0) / 2.0, 0) as int) as w, cast(round_even((y1 - y0) / 2.0, 0) as int) as h, cast(trunc((x - x0) / 2.0) as int) as col,
  cast(trunc(cast(round_even((y1 - y0) / 2.0, 0) as int) - (y - y0) / 2.0) as int) as row from points p join e using (tile_id, cloud)),
cells as (select * from i where col >= 0 and col < w and row >= 0 and row < h),
{_TRIMMED.format(v='hag', out=r('avg(hag)', 'v'), share=0.2)}""")
def raster_array_trimmed(spark, d):
    cells = g.raster_cells(b.points(spark, d), 2.0, keys=("tile_id", "cloud"))
    return cs.cell_statistic(cells, cs.TrimmedMean(0.2), "hag", KEYS)


# --- files and runs --------------------------------------------------------------


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"


@query("exact_chunks", """with rows as (select 'tile_' || cast(l_suppkey as varchar) as tile_id, l_extendedprice as v from lineitem),
t as (select tile_id, row_number() over (order by tile_id) - 1 as tile_number, count(*) as n, sum(v) as total from rows group by 1)
select tile_id, tile_number, cast(tile_number // 7 as int) as chunk_ix, n, round(total, 2) + 0.0 as total from t""")
def exact_chunks(spark, d):
    # Written as chunks of seven tiles and read back, all files and all tiles.
    rows = b.table(spark, d, "lineitem").selectExpr("concat('tile_', cast(l_suppkey as string)) as tile_id", "l_extendedprice as v")
    folder = _folder(spark)
    tl.write_chunks(rows, folder, 7)
    back = tl.read_chunks(spark, folder)
    return back.groupBy("tile_id", "tile_number", "chunk_ix").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("combined_chunks_all", """select 'chunk_' || cast(l_orderkey % 7 as varchar) || '.parquet' as source_file, 'tile_' || cast(l_suppkey as varchar) as tile_id,
  count(*) as n, round(sum(l_extendedprice), 2) + 0.0 as total from lineitem group by 1, 2""")
def combined_chunks_all(spark, d):
    rows = b.table(spark, d, "lineitem").selectExpr(
        "concat('chunk_', cast(l_orderkey % 7 as string), '.parquet') as source_file",
        "concat('tile_', cast(l_suppkey as string)) as tile_id", "l_extendedprice",
    )
    return tl.combine_chunks(rows).groupBy("source_file", "tile_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


def _lost(run: str, attempt: str) -> str:
    """Two of five attempts lose their connection."""
    return f"{draw(chr(39) + 'net' + chr(39), run, attempt, 'tile_id')} < 0.4"


def _attempt_sql(run: int, attempt: int, before: str) -> str:
    """The tiles that no earlier attempt has finished, with their outcome; three attempts in run 1, two in run 2."""
    return f"""a{run}{attempt} as (select tile_id, {run} as run, {attempt} as attempt, case when n < 450 then 'too_few_points' when {_lost(str(run), str(attempt))} then 'connection' end as reason
  from t where tile_id not in (select tile_id from {before} where reason is null)),
l{run}{attempt} as (select * from {before} union all select * from a{run}{attempt})"""


_LOG = f"""t as (select tile_id, count(*) filter (where cloud = 'uav') as n from points group by 1),
l0 as (select tile_id, 0 as run, 0 as attempt, '' as reason from t where false),
{_attempt_sql(1, 1, 'l0')}, {_attempt_sql(1, 2, 'l11')}, {_attempt_sql(2, 1, 'l12')}, {_attempt_sql(2, 2, 'l21')}"""


def _ledger(spark, d) -> str:
    """Two runs of two attempts; the last commit of each run is repeated, which adds nothing."""
    from tileloom.functions.draws import uniform

    folder = _folder(spark)
    counts = b.points(spark, d).groupBy("tile_id").agg(F.count(F.when(F.col("cloud") == "uav", 1)).alias("n"))
    for run in (1, 2):
        def work(todo, attempt, run=run):
            lost = uniform("net", str(run), str(attempt), F.col("tile_id")) < 0.4
            reason = F.when(F.col("n") < 450, "too_few_points").when(lost, "connection")
            return counts.join(todo, "tile_id", "left_semi").select("tile_id", reason.alias("reason"))

        at.run_attempts(folder, run, counts.select("tile_id"), work, 2)
        at.commit(folder, run, 2, counts.select("tile_id", F.lit("again").alias("reason")))
    return folder


@query("attempts_ledger", f"""with {POINTS}, {_LOG}
select run, attempt, case when reason is null then 'succeeded' else 'failed' end as status, reason, count(*) as n_tiles from l22 group by all""")
def attempts_ledger(spark, d):
    return at.attempts_summary(at.read_ledger(spark, _ledger(spark, d)))


@query("attempts_as_of", f"""with {POINTS}, {_LOG},
v as (select 'end' as moment, * from l22 union all select 'first run', * from l12 union all select 'first attempt', * from l11)
select moment, tile_id, case when bool_or(reason is null) then 'succeeded' else 'failed' end as status,
  case when bool_or(reason is null) then null else arg_max(reason, (run, attempt)) end as reason, count(*) as n_attempts from v group by moment, tile_id""")
def attempts_as_of(spark, d):
    log = at.read_ledger(spark, _ledger(spark, d))
    views = [("end", at.as_of(log)), ("first run", at.as_of(log, 1)), ("first attempt", at.as_of(log, 1, 1))]
    out = None
    for moment, view in views:
        part = view.withColumn("moment", F.lit(moment))
        out = part if out is None else out.unionByName(part)
    return out
