"""K and M families: neighbours and distances between clouds."""

from pyspark.sql import functions as F

from contract.base import EVAL, POINTS, draw, query, r, rr
from tileloom import bindings as b
from tileloom.operators import metrics as m, neighbors as nb

_D2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"
NN = f"""prs as (select p.tile_id, case when p.cloud = 'dep' then 'ab' else 'ba' end as side, p.pid, p.x, p.y, p.z,
    q.pid as n_pid, q.x as n_x, q.y as n_y, q.z as n_z, {_D2} as d2
  from points p join points q on p.tile_id = q.tile_id and p.cloud <> q.cloud),
nn as (select * from prs qualify row_number() over (partition by tile_id, side, pid, x, y, z order by d2, n_x, n_y, n_z, n_pid) = 1)"""
CNT = """cnt as (select tile_id, count(*) filter (where cloud = 'dep') as n_a, count(*) filter (where cloud = 'uav') as n_b from points group by 1)"""


def _knn(k: int, where: str = "true") -> str:
    return f"""kp as (select p.tile_id, p.pid, p.x, p.y, p.z, q.pid as n_pid, {_D2} as d2,
    row_number() over (partition by p.tile_id, p.pid, p.x, p.y, p.z order by {_D2}, q.x, q.y, q.z, q.pid) as rank
  from points p join points q on p.tile_id = q.tile_id and not (p.pid = q.pid and p.x = q.x and p.y = q.y and p.z = q.z)
  where p.cloud = 'dep' and q.cloud = 'dep' and {where}),
knn as (select * from kp where rank <= {k})"""


def _nn(spark, d, *want):
    return nb.both_ways(b.points(spark, d), "dep", "uav", want=list(want))


def _dep(spark, d):
    return b.points(spark, d).where("cloud = 'dep'")


@query("knn_graph", f"""with {POINTS}, {_knn(8)}
select tile_id, pid, n_pid, cast(rank as int) as rank, {r('d2')} from knn""")
def knn_graph(spark, d):
    return nb.knn_graph(_dep(spark, d), 8).select("tile_id", "pid", "n_pid", "rank", "d2")


@query("knn_undirected", f"""with {POINTS}, {_knn(4)}
select tile_id, 4 as k, pid as src, n_pid as dst from knn union select tile_id, 4, n_pid, pid from knn""")
def knn_undirected(spark, d):
    return nb.edge_table(_dep(spark, d), 4)


@query("knn_counting_self", f"""with {POINTS}, {_knn(2)}
select tile_id, pid, n_pid, {r('d2')} from knn""")
def knn_counting_self(spark, d):
    return nb.knn_graph(_dep(spark, d), 3, count_self=True).select("tile_id", "pid", "n_pid", "d2")


@query("cross_nearest", f"""with {POINTS}, {NN}
select tile_id, pid, n_pid, {rr('n_x', 'n_y', 'n_z', 'd2')} from nn where side = 'ab'""")
def cross_nearest(spark, d):
    return nb.cross_nearest(b.points(spark, d), "dep", "uav").select(
        "tile_id", "pid", "n_pid", "n_x", "n_y", "n_z", "d2"
    )


@query("one_sided_distance", f"""with {POINTS}, {NN} select tile_id, side, {r('avg(d2)', 'mean_d2')} from nn group by 1, 2""")
def one_sided_distance(spark, d):
    return m.one_sided(_nn(spark, d, "d2"))


@query("repulsion", f"""with {POINTS}, {_knn(5)}
select tile_id, {r('avg(greatest(0.9 - sqrt(d2 + 1e-8), 0) * exp(-(d2 + 1e-8) / 0.81))', 'repulsion')} from knn group by 1""")
def repulsion(spark, d):
    return nb.repulsion(_dep(spark, d), 5, 0.9)


_ENDS = ["x", "y", "z", "n_x", "n_y", "n_z"]
_GRAPHS = """g as (select 'tile_' || cast(l_suppkey as varchar) as tile_id, cast(l_linenumber * 2 as int) as k, l_orderkey as src, l_partkey as dst
  from lineitem)"""


@query("stored_graph_choice", f"""with {_GRAPHS},
c as (select tile_id, k from (select distinct tile_id, k from g) qualify row_number() over (partition by tile_id order by abs(k - 7), k) = 1)
select tile_id, k, src, dst from g join c using (tile_id, k)""")
def stored_graph_choice(spark, d):
    stored = b.table(spark, d, "lineitem").selectExpr(
        "concat('tile_', cast(l_suppkey as string)) as tile_id", "cast(l_linenumber * 2 as int) as k",
        "l_orderkey as src", "l_partkey as dst",
    )
    return nb.graph_for(stored, b.points(spark, d).where("cloud = 'dep'"), 7)


@query("patch_transfer", f"""with {POINTS},
pt as (select tile_id, 1.25 + 2.5 * c.i as px, 1.25 + 2.5 * w.i as py, sum(z) / 100 as v from points,
   (select unnest(range(4)) as i) c, (select unnest(range(4)) as i) w
   where least(cast(trunc(x / 2.5) as int), 3) = c.i and least(cast(trunc(y / 2.5) as int), 3) = w.i group by 1, 2, 3),
j as (select p.tile_id, p.pid, p.x, p.y, v, sqrt(pow(p.x - px, 2) + pow(p.y - py, 2)) as d from points p join pt using (tile_id) where cloud = 'dep'),
k as (select tile_id, pid, x, y, coalesce(sum(exp(-d / 0.8)) filter (where d <= 1.6), 0) as w, sum(exp(-d / 0.8) * v) filter (where d <= 1.6) as wv from j group by 1, 2, 3, 4)
select tile_id, pid, {rr('x', 'y')}, {r('case when w > 1e-6 then wv / w else 0 end', 'v')} from k""")
def patch_transfer(spark, d):
    from tileloom.operators.grid import cell_aggregate, fixed_box

    p = b.points(spark, d)
    cells = cell_aggregate(p, fixed_box(0, 0, 10, 10), 2.5, F.sum)
    patches = cells.selectExpr("tile_id", "1.25D + 2.5D * col as px", "1.25D + 2.5D * row as py", "v / 100 as v")
    return nb.patch_transfer(p.where("cloud = 'dep'"), patches, 1.6, 0.8)


@query("chamfer_squared", f"""with {POINTS}, {NN}, s as (select tile_id, side, avg(d2) as v from nn group by 1, 2)
select tile_id, {r('sum(v)', 'chamfer_distance')} from s group by 1""")
def chamfer_squared(spark, d):
    return m.chamfer_squared(_nn(spark, d, "d2"))


@query("chamfer_euclidean", f"""with {POINTS}, {NN}, s as (select tile_id, side, avg(sqrt(d2)) as v from nn group by 1, 2)
select tile_id, {r('sum(v)', 'chamfer_l2')} from s group by 1""")
def chamfer_euclidean(spark, d):
    return m.chamfer_euclidean(_nn(spark, d, "d2"))


@query("hausdorff", f"""with {POINTS}, {NN} select tile_id, {r('sqrt(max(d2))', 'hausdorff')} from nn group by 1""")
def hausdorff(spark, d):
    return m.hausdorff(_nn(spark, d, "d2"))


def _trim_sql(dist: str, ta: float, tb: float) -> str:
    return f"""d as (select tile_id, side, {dist} as d from nn),
rk as (select *, row_number() over (partition by tile_id, side order by d) as rn, count(*) over (partition by tile_id, side) as n from d),
tr as (select tile_id, side, sum(d) as s, count(*) as kept from rk
  where rn <= greatest(ceil(case when side = 'ab' then {1.0 - ta!r}::double else {1.0 - tb!r}::double end * n), 1) group by 1, 2)"""


_L1 = "abs(x - n_x) + abs(y - n_y) + abs(z - n_z)"
_HUBER = "case when sqrt(d2 + 1e-8) <= 0.6 then (d2 + 1e-8) * 0.5 else 0.6 * (sqrt(d2 + 1e-8) - 0.3) end"


@query("trimmed_chamfer", f"""with {POINTS}, {NN}, {_trim_sql(_L1, 0.0, 0.05)}
select tile_id, {r('sum(s / kept)', 'chamfer')} from tr group by 1""")
def trimmed_chamfer(spark, d):
    return m.general_chamfer(_nn(spark, d), batch=None, norm="L1", trim_ba=0.05)


@query("trimmed_chamfer_batch", f"""with {POINTS}, {NN}, {_trim_sql(_HUBER, 0.02, 0.01)},
w as (select tile_id, (count(*) % 5 + 1)::double as w from points group by 1),
v as (select side, sum(s * w) / sum(w * kept) as v from tr join w using (tile_id) group by 1) select {r('sum(v)', 'chamfer')} from v""")
def trimmed_chamfer_batch(spark, d):
    w = b.points(spark, d).groupBy("tile_id").agg((F.count(F.lit(1)) % 5 + 1).cast("double").alias("w"))
    return m.general_chamfer(
        _nn(spark, d), w, "mean", norm="Huber", delta=0.6, trim_ab=0.02, trim_ba=0.01, reduction="sum"
    )


@query("normals_distance", f"""with {POINTS}, {NN}, nv as (select tile_id, pid, sin(pid % 97) as a, cos(pid % 89) as c, sin(pid % 83) + 0.1 as e from points),
cs as (select nn.tile_id, side, 1 - abs((p.a * q.a + p.c * q.c + p.e * q.e) / (sqrt(p.a * p.a + p.c * p.c + p.e * p.e) * sqrt(q.a * q.a + q.c * q.c + q.e * q.e))) as v
  from nn join nv p on p.tile_id = nn.tile_id and p.pid = nn.pid join nv q on q.tile_id = nn.tile_id and q.pid = nn.n_pid),
s as (select tile_id, side, avg(v) as v from cs group by 1, 2) select tile_id, {r('sum(v)', 'normals')} from s group by 1""")
def normals_distance(spark, d):
    normals = b.points(spark, d).selectExpr("*", "sin(pid % 97) as nx", "cos(pid % 89) as ny", "sin(pid % 83) + 0.1D as nz")
    axes = ["nx", "ny", "nz"]
    want = [*axes, *[f"n_{c}" for c in axes]]
    return m.normals_distance(nb.both_ways(normals, "dep", "uav", want=want, carry=axes))


@query("density_aware_chamfer", f"""with {POINTS}, {NN}, {CNT},
q as (select *, count(*) over (partition by tile_id, side, n_pid, n_x, n_y, n_z) as q from nn),
l as (select tile_id, side, avg(1 - exp(-sqrt(greatest(d2, 1e-12))) / (greatest((case when side = 'ab' then n_a else n_b end)::double
   / (case when side = 'ab' then n_b else n_a end) / (q + 1e-12), 1) + 1e-12)) as v from q join cnt using (tile_id) group by 1, 2)
select tile_id, {r('sum(v) * 0.5', 'dcd')} from l group by 1""")
def density_aware_chamfer(spark, d):
    counts = b.points(spark, d).groupBy("tile_id").agg(
        F.count(F.when(F.col("cloud") == "dep", 1)).alias("n_a"), F.count(F.when(F.col("cloud") == "uav", 1)).alias("n_b")
    )
    return m.density_aware(_nn(spark, d, "d2", "n_shared"), counts)


@query("info_chamfer", f"""with {POINTS}, {NN}, {CNT},
s as (select tile_id, side, sum({_L1}) / (0.3 * count(*)) as cd, ln(sum(exp(-({_L1}) / 0.3))) as lse from nn group by 1, 2)
select tile_id, {r('sum(cd) + sum(3.0 / n_b * lse)', 'infocd')} from s join cnt using (tile_id) group by 1""")
def info_chamfer(spark, d):
    return m.info_chamfer(_nn(spark, d, *_ENDS))


@query("improvement_ratio", f"""with {EVAL}
select tile_id, {r('''case when isinf(combined_chamfer_distance) then input_chamfer_distance / 32000 when isnan(combined_chamfer_distance) then null
   else input_chamfer_distance / combined_chamfer_distance end''', 'ratio')},
  {r('''case when isinf(combined_chamfer_distance) or isnan(combined_chamfer_distance) then input_chamfer_distance / 32000
   else input_chamfer_distance / combined_chamfer_distance end''', 'guarded')} from eval""")
def improvement_ratio(spark, d):
    ev = b.evaluation(spark, d)
    a, z = F.col("input_chamfer_distance"), F.col("combined_chamfer_distance")
    return ev.select(
        "tile_id", F.when(~F.isnan(z), m.improvement_ratio(a, z)).alias("ratio"), m.improvement_ratio(a, z, "one").alias("guarded")
    )
