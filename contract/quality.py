"""F and S families: filters, checks and duplicates."""

from pyspark.sql import functions as F

from contract.base import (
    ITEMS, LOCAL_TILES, PIXELS, POINTS, TILES, draw, finite, query, r, rr,
)
from tileloom import bindings as b
from tileloom.operators import grid as g, quality as q
from tileloom.operators.spatial import in_box

COVER = """per_cell as (
  select tile_id, least(cast(trunc(x) as int), 9) as c, least(cast(trunc(y) as int), 9) as w, count(*) as n
  from points where cloud = 'uav' group by 1, 2, 3),
cover as (
  select tile_id, 100 as total_cells, count(*) filter (where n >= 5) as covered_cells,
    count(*) filter (where n >= 5) / 100.0::double * 100.0 as coverage_pct, avg(n) as avg_points
  from per_cell group by 1)"""


@query("tile_validity", f"""with {POINTS}, {LOCAL_TILES}, {COVER},
counts as (select tile_id, count(*) filter (where cloud = 'uav') as n_uav,
  count(*) filter (where cloud = 'dep') as n_dep from points group by 1),
j as (select t.tile_id, coalesce(n_uav, 0) as n_uav, coalesce(n_dep, 0) as n_dep, coverage_pct
  from tiles t left join counts c using (tile_id) left join cover v using (tile_id)),
k as (select *, case when n_uav = 0 then 'missing_uav' when n_uav < 480 then 'few_uav'
  when coalesce(coverage_pct, 0) < 56 then 'low_coverage' when n_dep = 0 then 'missing_dep'
  when n_dep < 60 then 'few_dep' when n_uav / n_dep::double < 5 then 'low_ratio' end as reason_code from j)
select tile_id, n_uav, n_dep, {r('coverage_pct')}, reason_code, reason_code is null as is_valid,
  case reason_code when 'missing_uav' then 'the tile has no UAV points'
    when 'few_uav' then format('UAV points: {{}}, wanted 480', n_uav)
    when 'low_coverage' then printf('covered by UAV points: %.1f%%, wanted 56%%', coverage_pct)
    when 'missing_dep' then 'the tile has no DEP points'
    when 'few_dep' then format('DEP points: {{}}, wanted 60', n_dep)
    when 'low_ratio' then printf('UAV points per DEP point: %.2f, wanted 5', n_uav / n_dep::double)
  end as reason
from k""")
def tile_validity(spark, d):
    checked = q.validate_tiles(
        b.local_tiles(spark, d), b.points(spark, d), 480, 60, 56.0, 5, 5.0
    )
    return checked.select("tile_id", "n_uav", "n_dep", "coverage_pct", "reason_code", "is_valid", "reason")


@query("tile_coverage", f"""with {POINTS}, {COVER}
select tile_id, cast(total_cells as bigint) as total_cells, covered_cells, {r('coverage_pct')},
  {r('avg_points', 'avg_points_per_occupied_cell')}, coverage_pct >= 56 as is_complete from cover""")
def tile_coverage(spark, d):
    uav = b.points(spark, d).where("cloud = 'uav'")
    return g.coverage(uav, g.fixed_box(0, 0, 10, 10), 1.0, 5, 56.0)


@query("invalid_reasons", f"""with {POINTS}, {LOCAL_TILES}, {COVER},
counts as (select tile_id, count(*) filter (where cloud = 'uav') as n_uav,
  count(*) filter (where cloud = 'dep') as n_dep from points group by 1),
j as (select tile_id, case when n_uav < 480 then 'few_uav' when coverage_pct < 56 then 'low_coverage'
  when n_dep < 60 then 'few_dep' when n_uav / n_dep::double < 5 then 'low_ratio' end as reason_code
  from counts join cover using (tile_id))
select reason_code, count(*) as n_tiles from j where reason_code is not null group by 1""")
def invalid_reasons(spark, d):
    return q.reason_histogram(
        q.validate_tiles(b.local_tiles(spark, d), b.points(spark, d), 480, 60, 56.0, 5, 5.0)
    )


@query("points_in_box", f"""with {POINTS}
select tile_id, count(*) filter (where x between 2 and 7.5 and y between 1.25 and 9) as n_closed,
  count(*) filter (where x >= 2 and x < 7.5 and y >= 1.25 and y < 9) as n_half_open
from points group by 1""")
def points_in_box(spark, d):
    box = g.fixed_box(2, 1.25, 7.5, 9)
    inside = lambda closed: F.count(F.when(in_box(F.col("x"), F.col("y"), box, closed), 1))
    return b.points(spark, d).groupBy("tile_id").agg(
        inside(True).alias("n_closed"), inside(False).alias("n_half_open")
    )


@query("tiles_in_area", f"""with {POINTS}, {TILES},
c as (select tile_id, (min(x) + max(x)) / 2 as px, (min(y) + max(y)) / 2 as py from points group by 1),
t as (select t.tile_id, s.s_suppkey as k, t.* exclude (tile_id) from tiles t join supplier s on t.tile_id = 'tile_' || cast(s.s_suppkey as varchar)),
m as (select t.tile_id, coalesce(case when k % 3 = 0 then 10.0 * (k % 10) + 5 end, case when k % 3 = 1 then (xmin + xmax) / 2 end, px) as cx,
  coalesce(case when k % 3 = 0 then 10.0 * (k // 10) + 5 end, case when k % 3 = 1 then (ymin + ymax) / 2 end, py) as cy
  from t left join c using (tile_id))
select tile_id, {rr('cx', 'cy')} from m where cx between 0 and 45 and cy between 0 and 60""")
def tiles_in_area(spark, d):
    k = F.regexp_extract("tile_id", r"(\d+)", 1).cast("long")
    tiles = b.tiles(spark, d).select(
        "tile_id",
        F.when(k % 3 == 0, F.lit(10.0) * (k % 10) + 5).alias("center_x"),
        F.when(k % 3 == 0, F.lit(10.0) * F.floor(k / 10) + 5).alias("center_y"),
        *[F.when(k % 3 == 1, F.col(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
    )
    return q.in_area_by_centre(tiles, b.points(spark, d), (0, 0, 45, 60)).select("tile_id", "cx", "cy")


@query("study_area_choice", f"""with {TILES}
select tile_id, case when (xmin + xmax) / 2 between 0 and 50 and (ymin + ymax) / 2 between 0 and 50
  then 'north' else 'south' end as area from tiles""")
def study_area_choice(spark, d):
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return b.tiles(spark, d).select(
        "tile_id", q.study_area(cx, cy, (0, 0, 50, 50), "north", "south").alias("area")
    )


@query("class_filters", f"""with {POINTS}
select tile_id, cast(count(*) filter (where classification = 2) as bigint) as n_ground,
  count(*) filter (where return_number = 1) as n_first,
  count(*) filter (where classification not in (7, 18)) as n_clean,
  count(*) filter (where hag between 2 and 15) as n_range from points group by 1""")
def class_filters(spark, d):
    p = b.points(spark, d)
    tagged = None
    for name, kept in (
        ("n_ground", q.ground(p)), ("n_first", q.first_returns(p)),
        ("n_clean", q.without_noise(p)), ("n_range", q.height_range(p, 2.0, 15.0)),
    ):
        one = kept.select("tile_id", F.lit(name).alias("k"))
        tagged = one if tagged is None else tagged.unionByName(one)
    names = ["n_ground", "n_first", "n_clean", "n_range"]
    return tagged.groupBy("tile_id").agg(*[F.count(F.when(F.col("k") == n, 1)).alias(n) for n in names])


@query("valid_shapes", f"""with {POINTS},
c as (select tile_id, count(*) filter (where cloud = 'uav') as n_uav,
  count(*) filter (where cloud = 'dep') as n_dep,
  max(least(cast(trunc(y) as int), 9)) + 1 as h, max(least(cast(trunc(x) as int), 9)) + 1 as w from points group by 1)
select tile_id, n_uav, n_dep from c where n_uav >= 500 and n_dep >= 50 and n_dep * 6.5 <= n_uav and h = 10 and w = 10""")
def valid_shapes(spark, d):
    p = b.points(spark, d)
    surface = g.cell_aggregate(p, g.fixed_box(0, 0, 10, 10), 1.0, F.max)
    return q.valid_shapes(q.counts_by_cloud(p), surface, 500, 50, 6.5).select("tile_id", "n_uav", "n_dep")


_DUP = """rows as (select case when l_orderkey % 11 = 0 then null else 'tile_' || cast(l_orderkey as varchar) end as tile_id,
  l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice from lineitem)"""


def _duplicate_rows(spark, d):
    return b.table(spark, d, "lineitem").selectExpr(
        "case when l_orderkey % 11 = 0 then null else concat('tile_', l_orderkey) end as tile_id",
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    )


_DUP_ORDER = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


@query("first_of_duplicates", f"""with {_DUP},
n as (select *, row_number() over (partition by tile_id order by {_DUP_ORDER}) as rn from rows)
select tile_id, l_partkey, l_suppkey, l_linenumber, {rr('l_quantity', 'l_extendedprice')}
from n where rn = 1 or tile_id is null""")
def first_of_duplicates(spark, d):
    return q.first_of_duplicates(_duplicate_rows(spark, d), _DUP_ORDER.split(", "))


@query("duplicate_counts", f"""with {_DUP}
select tile_id, count(*) - 1 as n_extra from rows where tile_id is not null group by 1 having count(*) > 1""")
def duplicate_counts(spark, d):
    return q.duplicate_counts(_duplicate_rows(spark, d))


@query("height_cap", f"""with {POINTS},
s as (select tile_id, avg(case when z <= 16 then 1.0 else 0.0 end) as share from points where cloud = 'uav' group by 1)
select p.tile_id, cloud, count(*) as n, {r('max(z)', 'max_z')} from points p join s using (tile_id)
where share >= 0.8 and (cloud <> 'uav' or z <= 16) group by 1, 2""")
def height_cap(spark, d):
    kept = q.cap_height(b.points(spark, d), 16.0, 0.8)
    return kept.groupBy("tile_id", "cloud").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("max_z"))


@query("images_with_data", f"""with {PIXELS},
k as (select tile_id, dt, band from pixels group by 1, 2, 3 having bool_or({finite('v')}))
select tile_id, dt, band, count(*) as n_pixels from pixels join k using (tile_id, dt, band) group by 1, 2, 3""")
def images_with_data(spark, d):
    key = ["tile_id", "dt", "band"]
    kept = q.images_with_data(b.pixels(spark, d), key)
    return kept.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pixels"))


@query("augmentation_violations", f"""with {POINTS}, {PIXELS},
a as (select tile_id, count(*) as n, max(greatest(abs(x), abs(y), abs(z))) as big from points where cloud = 'dep' group by 1),
i as (select tile_id, sensor, bool_or(isnan(v)) as bad, bool_or(isinf(v)) as inf from pixels group by 1, 2)
select tile_id, 'too_few_points' as violation from a where n < 85
union all select tile_id, 'extreme_points' from a where big > 20.9
union all select tile_id, 'nan_' || sensor from i where bad
union all select tile_id, 'inf_' || sensor from i where inf""")
def augmentation_violations(spark, d):
    return q.augmentation_violations(b.points(spark, d), b.pixels(spark, d), "dep", 85, 20.9)


@query("common_columns_union", f"""with {POINTS}
select cloud, count(*) as n, {r('sum(x)', 'sx', 3)}, {r('sum(z)', 'sz', 3)} from points group by 1""")
def common_columns_union(spark, d):
    p = b.points(spark, d)
    dep = p.where("cloud = 'dep'").select("tile_id", "cloud", "x", "y", "z", "intensity")
    uav = p.where("cloud = 'uav'").select("z", "x", "cloud", "tile_id", "classification")
    both = q.common_union(dep, uav)
    assert both.columns == ["tile_id", "cloud", "x", "z"]
    return both.groupBy("cloud").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("z"), 3).alias("sz")
    )


@query("gate_before_join", f"""with {POINTS},
k as (select tile_id from points where cloud = 'uav' group by 1 having count(*) >= 520)
select tile_id, count(*) as n_dep from points join k using (tile_id) where cloud = 'dep' group by 1""")
def gate_before_join(spark, d):
    p = b.points(spark, d)
    dep = p.where("cloud = 'dep'")
    return q.enough_points(dep, p, "uav", 520).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_dep"))


@query("first_item_per_date", f"""with {ITEMS},
n as (select *, row_number() over (partition by cast(dt as date) order by item_id) as rn from items)
select item_id, cast(dt as date) as day, {rr('minx', 'miny')} from n where rn = 1""")
def first_item_per_date(spark, d):
    found = q.first_item_per_date(b.items(spark, d))
    return found.select("item_id", F.to_date("dt").alias("day"), "minx", "miny")


@query("first_dates_of_items", f"""with {ITEMS},
n as (select *, row_number() over (partition by cast(dt as date) order by item_id) as rn from items)
select item_id, cast(dt as date) as day, {rr('minx', 'miny')} from n where rn = 1 order by day limit 100""")
def first_dates_of_items(spark, d):
    found = q.first_item_per_date(b.items(spark, d), most=100)
    return found.select("item_id", F.to_date("dt").alias("day"), "minx", "miny")


@query("capped_cloud", f"""with {POINTS},
n as (select *, row_number() over (partition by tile_id order by {draw("'42'", 'tile_id', 'pid')}, x, y, z, pid) as rn
  from points where cloud = 'uav')
select tile_id, pid, {rr('x', 'y', 'z')} from n where rn <= 100""")
def capped_cloud(spark, d):
    kept = q.cap_points(b.points(spark, d), "uav", 100, "42")
    return kept.where("cloud = 'uav'").select("tile_id", "pid", "x", "y", "z")


@query("capped_sparse_cloud", f"""with {POINTS},
n as (select *, row_number() over (partition by tile_id order by {draw("'42'", 'tile_id', 'pid')}, x, y, z, pid) as rn
  from points where cloud = 'dep')
select tile_id, pid, {rr('x', 'y', 'z')} from n where rn <= 85""")
def capped_sparse_cloud(spark, d):
    """The cap lies between the sizes of the clouds: smaller ones stay whole."""
    kept = q.cap_points(b.points(spark, d), "dep", 85, "42")
    return kept.where("cloud = 'dep'").select("tile_id", "pid", "x", "y", "z")


_SUM = ", ".join(
    f"{r(f'{e}({a}) filter (where cloud = {c!r})', f'{a}_{e}_{c}')}"
    for c in ("dep", "uav") for a in "xyz" for e in ("min", "max")
)
_GAP = ", ".join(
    r(f"{e}({a}) filter (where cloud = 'uav') - {e}({a}) filter (where cloud = 'dep')", f"{a}_{e}_diff")
    for a in "xyz" for e in ("min", "max")
)


@query("tile_summary", f"""with {POINTS}
select tile_id, count(*) filter (where cloud = 'dep') as n_dep, count(*) filter (where cloud = 'uav') as n_uav,
{_SUM}, {_GAP} from points group by 1""")
def tile_summary(spark, d):
    return q.tile_summary(b.points(spark, d))
