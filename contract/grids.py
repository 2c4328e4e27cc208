"""G family: grids, surfaces and structure metrics per cell."""

import math

from pyspark.sql import functions as F

from contract.base import CLOUD_POINTS, LOCAL_TILES, PIXELS, POINTS, query, r, rr
from tileloom import bindings as b
from tileloom.operators import canopy as c, grid as g

BOX = (0.0, 0.0, 10.0, 10.0)
CELLS1 = """cells as (select *, least(cast(trunc(y / 1.0) as int), 9) as row, least(cast(trunc(x / 1.0) as int), 9) as col
  from points)"""
CELLS25 = """cells as (select *, least(cast(trunc(y / 2.5) as int), 3) as row, least(cast(trunc(x / 2.5) as int), 3) as col
  from points)"""


def _mad(threshold: float, source: str = "cells") -> str:
    return f"""med as (select tile_id, row, col, quantile_cont(z, 0.5) as m from {source} group by 1, 2, 3),
offs as (select c.*, abs(z - m) as o from {source} c join med using (tile_id, row, col)),
mads as (select tile_id, row, col, quantile_cont(o, 0.5) as mad from offs group by 1, 2, 3),
kept as (select o.* from offs o join mads using (tile_id, row, col) where mad <= 0 or o <= {threshold} * mad)"""


@query("cell_mean", f"""with {CLOUD_POINTS}, {CELLS1}
select tile_id, row, col, {r('avg(z)', 'v')} from cells group by 1, 2, 3""")
def cell_mean(spark, d):
    return g.cell_aggregate(b.cloud_points(spark, d), g.fixed_box(*BOX), 1.0, F.avg)


@query("cell_max_without_outliers", f"""with {POINTS}, {CELLS25}, {_mad(1.5)}
select tile_id, row, col, {r('max(z)', 'v')} from kept group by 1, 2, 3""")
def cell_max_without_outliers(spark, d):
    return g.cell_aggregate_clean(b.points(spark, d), g.fixed_box(*BOX), 2.5, F.max, "z", 1.5)


@query("canopy_height", f"""with {POINTS}, {CELLS25}, {_mad(3.0)},
top as (select tile_id, row, col, max(z) as dsm from kept group by 1, 2, 3),
low as (select tile_id, row, col, min(z) as dtm from cells group by 1, 2, 3)
select tile_id, row, col, {rr('dsm', 'dtm')}, {r('dsm - dtm', 'chm')} from top join low using (tile_id, row, col)""")
def canopy_height(spark, d):
    return g.canopy_height(b.points(spark, d), g.fixed_box(*BOX), 2.5)


_FILL = """occ as (select tile_id, cast(trunc(y / 0.5) as int) as row, cast(trunc(x / 0.5) as int) as col, min(z) as v
  from points where x < 10 and y < 10 group by 1, 2, 3),
full_grid as (select t.tile_id, rr.i as row, cc.i as col from (select distinct tile_id from points) t,
  (select unnest(range(20)) as i) rr, (select unnest(range(20)) as i) cc)"""


@query("grid_fill_nearest", f"""with {CLOUD_POINTS}, {_FILL},
d as (select f.tile_id, f.row, f.col, o.v, row_number() over (partition by f.tile_id, f.row, f.col
    order by (o.row - f.row) * (o.row - f.row) + (o.col - f.col) * (o.col - f.col), o.row, o.col) as rn
  from full_grid f join occ o on o.tile_id = f.tile_id)
select tile_id, cast(row as int) as row, cast(col as int) as col, {r('v')} from d where rn = 1""")
def grid_fill_nearest(spark, d):
    p = b.cloud_points(spark, d)
    low = g.min_surface(p, g.fixed_box(*BOX), 0.5)
    return g.fill_nearest(low, p.select("tile_id").distinct(), 20, 20)


@query("grid_fill_constant", f"""with {CLOUD_POINTS}, {_FILL}
select f.tile_id, cast(f.row as int) as row, cast(f.col as int) as col, {r('coalesce(v, -1)', 'v')}
from full_grid f left join occ using (tile_id, row, col)""")
def grid_fill_constant(spark, d):
    p = b.cloud_points(spark, d)
    low = g.min_surface(p, g.fixed_box(*BOX), 0.5)
    return g.fill_constant(low, p.select("tile_id").distinct(), 20, 20, -1.0)


@query("max_surface", f"""with {POINTS}
select tile_id, cast(floor((y - 1) / 1.0) as int) as row, cast(floor((x - 1) / 1.0) as int) as col, {r('max(z)', 'v')}
from points where floor((y - 1) / 1.0) between 0 and 7 and floor((x - 1) / 1.0) between 0 and 7 group by 1, 2, 3""")
def max_surface(spark, d):
    return g.max_surface(b.points(spark, d), g.fixed_box(1, 1, 9, 9), 1.0)


@query("min_surface", f"""with {POINTS}
select tile_id, cast(trunc(y - 1) as int) as row, cast(trunc(x - 1) as int) as col, {r('min(z)', 'v')}
from points where x >= 1 and x < 9 and y >= 1 and y < 9 group by 1, 2, 3""")
def min_surface(spark, d):
    return g.min_surface(b.points(spark, d), g.fixed_box(1, 1, 9, 9), 1.0)


def _pmf_sql():
    parts = [
        "g0 as (select tile_id, cast(trunc(y) as int) as row, cast(trunc(x) as int) as col, min(z) as v "
        "from points where x < 10 and y < 10 group by 1, 2, 3)"
    ]
    for i, w in enumerate(range(3, 22, 2)):
        h, t = w // 2, repr(0.15 * w * 1.0)
        parts.append(
            f"m{i} as (select *, min(v) over (partition by tile_id, row order by col range between {h} preceding and {h} following) as m from g{i})"
        )
        parts.append(
            f"e{i} as (select *, min(m) over (partition by tile_id, col order by row range between {h} preceding and {h} following) as e from m{i})"
        )
        parts.append(
            f"g{i + 1} as (select tile_id, row, col, case when v - e > {t}::double then e + {t}::double else v end as v from e{i})"
        )
    return ",\n".join(parts)


@query("progressive_ground", f"with {CLOUD_POINTS}, {_pmf_sql()}\nselect tile_id, row, col, {r('v')} from g10")
def progressive_ground(spark, d):
    low = g.min_surface(b.cloud_points(spark, d), g.fixed_box(*BOX), 1.0)
    return g.progressive_ground(low, 1.0)


def _idw_sql(nodes, radius):
    step = "0.5 + i" if nodes == "centre" else f"i * {10.0 / 9.0!r}::double"
    near = f"where d < {radius}" if radius else ""
    return f"""with {CLOUD_POINTS},
src as (select tile_id, cast(trunc(x) as int) + 0.5::double as sx, cast(trunc(y) as int) + 0.5::double as sy, min(z) as v
  from points where x < 10 and y < 10 group by 1, 2, 3),
ax as (select i, {step} as p from (select unnest(range(10)) as i)),
prs as (select tile_id, a.i as row, c.i as col, v, sqrt(pow(sx - c.p, 2) + pow(sy - a.p, 2)) as d from src, ax a, ax c),
agg as (select tile_id, row, col, min(v) filter (where d = 0) as hit,
  sum(v / pow(d, 2)) filter (where d > 0) as wv, sum(1 / pow(d, 2)) filter (where d > 0) as w from prs {near} group by 1, 2, 3)
select tile_id, cast(row as int) as row, cast(col as int) as col, {r('coalesce(hit, wv / w)', 'v')} from agg"""


@query("idw_surface", _idw_sql("linspace", None))
def idw_surface(spark, d):
    low = g.min_surface(b.cloud_points(spark, d), g.fixed_box(*BOX), 1.0)
    return g.idw_surface(low, BOX, 1.0, nodes="linspace")


@query("idw_surface_radius", _idw_sql("centre", 2.2))
def idw_surface_radius(spark, d):
    low = g.min_surface(b.cloud_points(spark, d), g.fixed_box(*BOX), 1.0)
    return g.idw_surface(low, BOX, 1.0, radius=2.2)


def _smooth_sql():
    kernel = ", ".join(f"({k - 4}, {w!r}::double)" for k, w in enumerate(g.gaussian_weights(1.0)))
    mirror = "least((({0}) % 8 + 8) % 8, 7 - (({0}) % 8 + 8) % 8)"
    return f"""with {CLOUD_POINTS}, cells as (select *, least(cast(trunc(y / 2.5) as int), 3) as row,
  least(cast(trunc(x / 2.5) as int), 3) as col from points), {_mad(5.0)},
g as (select tile_id, row, col, min(z) as v from kept group by 1, 2, 3),
full_grid as (select t.tile_id, rr.i as row, cc.i as col from (select distinct tile_id from points) t,
  (select unnest(range(4)) as i) rr, (select unnest(range(4)) as i) cc),
nn as (select f.tile_id, f.row, f.col, o.v, row_number() over (partition by f.tile_id, f.row, f.col
    order by (o.row - f.row) * (o.row - f.row) + (o.col - f.col) * (o.col - f.col), o.row, o.col) as rn
  from full_grid f join g o on o.tile_id = f.tile_id),
f0 as (select tile_id, row, col, v from nn where rn = 1),
kern(o, w) as (values {kernel}),
f1 as (select t.tile_id, t.row, t.col, sum(w * s.v) as v from f0 t, kern k, f0 s
  where s.tile_id = t.tile_id and s.col = t.col and s.row = {mirror.format('t.row + k.o')} group by 1, 2, 3),
f2 as (select t.tile_id, t.row, t.col, sum(w * s.v) as v from f1 t, kern k, f1 s
  where s.tile_id = t.tile_id and s.row = t.row and s.col = {mirror.format('t.col + k.o')} group by 1, 2, 3),
ax as (select i, i * {3.0 / 9.0!r}::double as f, least(cast(floor(i * {3.0 / 9.0!r}::double) as int), 2) as b from (select unnest(range(10)) as i)),
co as (select unnest([0, 1]) as a),
up as (select s.tile_id, y.i as row, x.i as col,
    sum((case when ca.a = 1 then y.f - y.b else 1 - (y.f - y.b) end) * (case when cb.a = 1 then x.f - x.b else 1 - (x.f - x.b) end) * s.v) as v
  from ax y, ax x, co ca, co cb, f2 s where s.row = y.b + ca.a and s.col = x.b + cb.a group by 1, 2, 3)
select tile_id, cast(row as int) as row, cast(col as int) as col, {r('v')} from up"""


@query("smoothed_terrain", _smooth_sql())
def smoothed_terrain(spark, d):
    return g.smoothed_terrain(b.cloud_points(spark, d), BOX)


_RASTER = """ext as (select tile_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from points group by 1),
ras as (select p.tile_id, hag, cast(trunc((x - x0) / 1.0) as int) as col,
    cast(trunc(round_even((y1 - y0) / 1.0, 0) - (y - y0) / 1.0) as int) as row,
    cast(round_even((x1 - x0) / 1.0, 0) as int) as w, cast(round_even((y1 - y0) / 1.0, 0) as int) as h
  from points p join ext using (tile_id)),
ins as (select * from ras where row >= 0 and row < h and col >= 0 and col < w)"""


@query("raster_array_mean", f"""with {POINTS}, {_RASTER}
select tile_id, row, col, {r('avg(hag)', 'v')} from ins group by 1, 2, 3""")
def raster_array_mean(spark, d):
    return g.raster_array(b.points(spark, d), 1.0, F.avg)


@query("raster_array_bands", f"""with {POINTS}, {_RASTER},
q as (select tile_id, row, col, quantile_cont(hag, [0.1, 0.5, 0.9]) as qs from ins group by 1, 2, 3)
select tile_id, row, col, cast(i as int) as band, {r('qs[i + 1]', 'v')} from q, (select unnest([0, 1, 2]) as i)""")
def raster_array_bands(spark, d):
    return g.raster_array(b.points(spark, d), 1.0, None, ps=[0.1, 0.5, 0.9])


@query("density_metrics", f"""with {POINTS}, {CELLS25}
select tile_id, row, col, count(*) as point_density,
  {r("coalesce(count(*) filter (where hag > 5) / nullif(count(*) filter (where hag > 0.1), 0)::double, 0)", "canopy_density")},
  {r("coalesce(count(*) filter (where hag >= 1 and hag < 5) / nullif(count(*) filter (where hag > 0.1), 0)::double, 0)", "mid_density")},
  {r("coalesce(count(*) filter (where hag > 0.1 and hag <= 1) / nullif(count(*) filter (where hag > 0.1), 0)::double, 0)", "under_density")},
  {r("count(*) filter (where hag > 5) / count(*)::double", "canopy_cover")}
from cells group by 1, 2, 3""")
def density_metrics(spark, d):
    return c.density_metrics(g.with_cells(b.points(spark, d), g.fixed_box(*BOX), 2.5))


_LAYERS = f"""lay as (select tile_id, row, col, cast(floor((hag - 1) / {(18 - 1) / 6!r}::double) as int) as layer from cells),
cnt as (select tile_id, row, col, layer, count(*) as n from lay where layer between 0 and 5 group by 1, 2, 3, 4),
prop as (select tile_id, row, col, layer, n / sum(n) over (partition by tile_id, row, col)::double as p from cnt)"""


@query("layer_proportions", f"""with {POINTS}, {CELLS25}, {_LAYERS}
select tile_id, row, col, layer, {r('p')} from prop""")
def layer_proportions(spark, d):
    return c.layer_proportions(g.with_cells(b.points(spark, d), g.fixed_box(*BOX), 2.5), 1.0, 18.0, 6)


@query("layer_diversity", f"""with {POINTS}, {CELLS25}, {_LAYERS}
select tile_id, row, col, {r('-sum(p * ln(p))', 'fhd')} from prop group by 1, 2, 3""")
def layer_diversity(spark, d):
    cells = g.with_cells(b.points(spark, d), g.fixed_box(*BOX), 2.5)
    return c.layer_diversity(c.layer_proportions(cells, 1.0, 18.0, 6))


@query("height_statistics", f"""with {POINTS}, {CELLS25},
q as (select tile_id, row, col, max(hag) as h_max, avg(hag) as h_mean, min(hag) as h_min, stddev_pop(hag) as h_std,
  quantile_cont(hag, [0.1, 0.25, 0.5, 0.75, 0.9]) as s from cells group by 1, 2, 3)
select tile_id, row, col, {rr('h_max', 'h_mean', 'h_min', 'h_std')},
  {r('s[1]', 'p10')}, {r('s[2]', 'p25')}, {r('s[3]', 'p50')}, {r('s[4]', 'p75')}, {r('s[5]', 'p90')} from q""")
def height_statistics(spark, d):
    return c.height_statistics(g.with_cells(b.points(spark, d), g.fixed_box(*BOX), 2.5))


@query("canopy_height_change", f"""with {POINTS},
pc as (select tile_id, cloud, floor((x - 5 + 5) / 2) as c, floor((y - 5 + 5) / 2) as w, quantile_cont(z, 0.95) as q
  from points where z <= 20 and floor((x - 5 + 5) / 2) between 0 and 4 and floor((y - 5 + 5) / 2) between 0 and 4 group by 1, 2, 3, 4),
m as (select tile_id, avg(q) filter (where cloud = 'dep') as a, avg(q) filter (where cloud = 'uav') as z from
  (select tile_id, cloud, avg(q) as q from pc group by 1, 2) group by 1)
select tile_id, {r('a', 'input_mean_pct95_z')}, {r('z', 'gt_mean_pct95_z')}, {r('z - a', 'net_canopy_height_change')} from m""")
def canopy_height_change(spark, d):
    moved = b.points(spark, d).withColumn("x", F.col("x") - 5).withColumn("y", F.col("y") - 5)
    return c.canopy_height_change(moved, "dep", "uav", cap=20.0)


@query("standard_rasters", f"""with {POINTS}, {CELLS1}
select tile_id, row, col, {r('min(hag)', 'v_min')}, {r('max(hag)', 'v_max')}, {r('avg(hag)', 'v_mean')},
  count(*) as v_count, {r('stddev_pop(hag)', 'v_std')} from cells group by 1, 2, 3""")
def standard_rasters(spark, d):
    return g.standard_rasters(b.points(spark, d), g.fixed_box(*BOX), 1.0)


@query("cell_value_to_points", f"""with {POINTS}, {CELLS1},
a as (select tile_id, row, col, max(z) as v from cells where cloud = 'uav' group by 1, 2, 3)
select c.tile_id, pid, {r('z')}, {r('a.v', 'agg_val')} from cells c left join a using (tile_id, row, col) where cloud = 'dep'""")
def cell_value_to_points(spark, d):
    p = b.points(spark, d)
    top = g.cell_aggregate(p.where("cloud = 'uav'"), g.fixed_box(*BOX), 1.0, F.max)
    dep = p.where("cloud = 'dep'")
    return g.back_to_points(dep, top, g.fixed_box(*BOX), 1.0, 10, 10).select("tile_id", "pid", "z", "agg_val")


@query("height_above_ground", f"""with {POINTS}, {CELLS1},
a as (select tile_id, row, col, min(z) as v from cells group by 1, 2, 3)
select tile_id, cloud, {r('avg(z - v)', 'mean_hag')}, {r('max(z - v)', 'max_hag')}
from cells join a using (tile_id, row, col) group by 1, 2""")
def height_above_ground(spark, d):
    found = c.height_above_ground(b.points(spark, d), g.fixed_box(*BOX), 1.0, 10, 10)
    return found.groupBy("tile_id", "cloud").agg(F.avg("hag").alias("mean_hag"), F.max("hag").alias("max_hag"))


@query("raster_difference", f"""with {POINTS}, {CELLS1},
a as (select tile_id, row, col, max(z) filter (where cloud = 'uav') as u, max(z) filter (where cloud = 'dep') as v from cells group by 1, 2, 3),
df as (select tile_id, row, col, u - v as d from a where u is not null and v is not null),
l as (select tile_id, quantile_cont(abs(d), 0.95) as lim from df group by 1)
select tile_id, row, col, {r('d')}, {r('least(greatest(d, -lim), lim)', 'd_clipped')} from df join l using (tile_id)""")
def raster_difference(spark, d):
    p, box = b.points(spark, d), g.fixed_box(*BOX)
    top = lambda cloud: g.cell_aggregate(p.where(F.col("cloud") == cloud), box, 1.0, F.max)
    return g.raster_difference(top("uav"), top("dep"), ["tile_id", "row", "col"], ["tile_id"])


@query("raster_difference_bands", f"""with {POINTS}, {CELLS1},
a as (select tile_id, row, col, max(z) filter (where cloud = 'uav') as u0, max(z) filter (where cloud = 'dep') as v0,
  min(z) filter (where cloud = 'uav') as u1, min(z) filter (where cloud = 'dep') as v1 from cells group by 1, 2, 3),
df as (select tile_id, 0 as band, row, col, u0 - v0 as d from a where u0 is not null and v0 is not null
  union all select tile_id, 1, row, col, u1 - v1 from a where u0 is not null and v0 is not null),
l as (select tile_id, band, quantile_cont(abs(d), 0.95) as lim from df group by 1, 2)
select tile_id, band, row, col, {r('d')}, {r('least(greatest(d, -lim), lim)', 'd_clipped')} from df join l using (tile_id, band)""")
def raster_difference_bands(spark, d):
    p, box = b.points(spark, d), g.fixed_box(*BOX)

    def bands(cloud):
        mine = p.where(F.col("cloud") == cloud)
        return g.stack_bands(g.cell_aggregate(mine, box, 1.0, F.max), g.cell_aggregate(mine, box, 1.0, F.min))

    return g.raster_difference(bands("uav"), bands("dep"), ["tile_id", "band", "row", "col"], ["tile_id", "band"])


@query("valid_footprint", f"""with {PIXELS}
select tile_id, count(*) filter (where not isnan(v) and v <> 0.5) as n_valid,
  {r('count(*) filter (where not isnan(v) and v <> 0.5) * 0.25::double', 'area')} from pixels group by 1""")
def valid_footprint(spark, d):
    return g.valid_footprint(b.pixels(spark, d), 0.5, 0.5)


@query("covered_windows", f"""with {CLOUD_POINTS}, {CELLS1},
a as (select tile_id, row, col, max(z) as v from cells group by 1, 2, 3)
select tile_id, row // 2 as wr, col // 2 as wc from a where v <> 0 group by 1, 2, 3 having count(*) = 4""")
def covered_windows(spark, d):
    cells = g.cell_aggregate(b.cloud_points(spark, d), g.fixed_box(*BOX), 1.0, F.max)
    return g.covered_windows(cells, 2).select("tile_id", F.col("wr").cast("int"), F.col("wc").cast("int"))


# The hull by wrapping: from each vertex the next one is that with the smallest turn, the farthest of equal ones.
@query("convex_hull", f"""with recursive {CLOUD_POINTS}, pts as (select distinct tile_id, x, y from points),
first as (select tile_id, x, y from pts qualify row_number() over (partition by tile_id order by x, y) = 1),
hull as (select tile_id, cast(0 as int) as ix, x, y, -pi() / 2 as dir from first
  union all select tile_id, ix, x, y, dir from (
    select h.tile_id, cast(h.ix + 1 as int) as ix, p.x, p.y, atan2(p.y - h.y, p.x - h.x) as dir, row_number() over (partition by h.tile_id
      order by round(fmod(atan2(p.y - h.y, p.x - h.x) - h.dir + 4 * pi(), 2 * pi()), 13), pow(p.x - h.x, 2) + pow(p.y - h.y, 2) desc) as rn
    from hull h join pts p on p.tile_id = h.tile_id and (p.x <> h.x or p.y <> h.y)) where rn = 1 and (tile_id, x, y) not in (select (tile_id, x, y) from first))
select tile_id, ix, {rr('x', 'y')} from hull""")
def convex_hull(spark, d):
    return g.convex_hull(b.cloud_points(spark, d))
