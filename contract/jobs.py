"""V, T, J7, D families and the composed jobs."""

from pyspark.sql import functions as F

from contract.base import LOCAL_TILES, PIXELS, POINTS, POLYS, TILES, draw, query, r, rr
from contract.places import _poly_sql
from contract.quality import COVER
from tileloom import bindings as b
from tileloom.operators import normalize as nz, quality as q, voxel as vx
from tileloom.plans import evaluation as ev, split_precompute as sp, tile_build as tb

COLS = ["tile_id", "pid", "x", "y", "z"]
UAV = "uav as (select tile_id, pid, x, y, z from points where cloud = 'uav')"


def _uav(spark, d):
    return b.points(spark, d).where("cloud = 'uav'").select(*COLS)


def _voxel_sql(size: str, ratio: float, source: str = "uav") -> str:
    return f"o as (select tile_id, min(x) as x0, min(y) as y0, min(z) as z0 from {source} group by 1),\n" + _thinned_sql(size, ratio, source)


def _thinned_sql(size: str, ratio: float, source: str) -> str:
    return f"""vx as (select u.*, floor((x - x0) / {size}) as vx, floor((y - y0) / {size}) as vy, floor((z - z0) / ({size} * {ratio!r}::double)) as vz from {source} u join o using (tile_id)),
ct as (select tile_id, vx, vy, vz, avg(x) as cx, avg(y) as cy, avg(z) as cz from vx group by 1, 2, 3, 4),
bs as (select tile_id, pid, x, y, z from vx join ct using (tile_id, vx, vy, vz)
  qualify row_number() over (partition by tile_id, vx, vy, vz order by round(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2), 9), pid, x, y, z) = 1)"""


@query("voxel_downsample", f"with {POINTS}, {UAV}, {_voxel_sql('2.5::double', 1.0)} select tile_id, pid, {rr('x', 'y', 'z')} from bs")
def voxel_downsample(spark, d):
    return vx.voxel_downsample(_uav(spark, d), 2.5)


@query("voxel_downsample_flat", f"with {POINTS}, {UAV}, {_voxel_sql('2.5::double', 0.5)} select tile_id, pid, {rr('x', 'y', 'z')} from bs")
def voxel_downsample_flat(spark, d):
    return vx.voxel_downsample(_uav(spark, d), 2.5, 0.5)


@query("voxel_counts", f"""with {POINTS}, {UAV}, s as (select tile_id, 1.0 + count(*) % 7 * 0.25 as size from uav group by 1),
o as (select tile_id, min(x) as x0, min(y) as y0, min(z) as z0 from uav group by 1)
select tile_id, count(distinct (floor((x - x0) / size), floor((y - y0) / size), floor((z - z0) / (size * 0.5::double)))) as n_voxels
from uav join o using (tile_id) join s using (tile_id) group by 1""")
def voxel_counts(spark, d):
    uav = _uav(spark, d)
    sizes = uav.groupBy("tile_id").agg((F.lit(1.0) + F.count(F.lit(1)) % 7 * 0.25).alias("size"))
    return vx.voxel_counts(uav, sizes, 0.5)


def _bisect_sql(most: int, start: float, rounds: int, ratio: float = 1.0) -> str:
    """The same set-wise search, unrolled."""
    parts = [f"s0 as (select tile_id, {start}::double as lo, {start * 10}::double as hi, null::double as best, null::bigint as bn from uav group by 1)"]
    for i in range(rounds):
        parts.append(
            f"n{i} as (select tile_id, count(distinct (floor((x - x0) / ((lo + hi) / 2 / 100)), floor((y - y0) / ((lo + hi) / 2 / 100)), "
            f"floor((z - z0) / ((lo + hi) / 2 / 100 * {ratio!r}::double)))) as n from uav join o using (tile_id) join s{i} using (tile_id) where hi - lo > 0.5 group by 1)"
        )
        parts.append(
            f"s{i + 1} as (select tile_id, case when n > {most} then (lo + hi) / 2 else lo end as lo, case when n <= {most} then (lo + hi) / 2 else hi end as hi, "
            f"case when n <= {most} and (bn is null or n > bn) then (lo + hi) / 2 else best end as best, "
            f"case when n <= {most} and (bn is null or n > bn) then n else bn end as bn from s{i} left join n{i} using (tile_id))"
        )
    return ",\n".join(parts)


@query("adaptive_voxel_sizes", f"""with {POINTS}, {UAV}, o as (select tile_id, min(x) as x0, min(y) as y0, min(z) as z0 from uav group by 1),
{_bisect_sql(300, 20.0, 10)} select tile_id, {r('best', 'size_cm')} from s10""")
def adaptive_voxel_sizes(spark, d):
    return vx.adaptive_sizes(_uav(spark, d), 300, 20.0, 1.0).select("tile_id", "size_cm")


def _growth_sql(most: int, ratio: float, start: str, passes: int) -> str:
    """Sizes that grow until the cap is met, unrolled; ``g<passes>`` has the final ones."""
    parts = [f"g0 as (select tile_id, lo as cur, best from {start})"]
    factor = 0.5
    for i in range(passes):
        parts.append(
            f"m{i} as (select tile_id, count(distinct (floor((x - x0) / (cur / 100)), floor((y - y0) / (cur / 100)), "
            f"floor((z - z0) / (cur / 100 * {ratio!r}::double)))) as n from uav join o using (tile_id) join g{i} using (tile_id) where best is null group by 1)"
        )
        more = f"least(5.0::double, {factor!r}::double * (n::double / {most}.0::double))"
        parts.append(
            f"g{i + 1} as (select tile_id, case when n > {most} then cur + {more} else cur end as cur, "
            f"case when n <= {most} then cur else best end as best from g{i} left join m{i} using (tile_id))"
        )
        factor *= 1.2
    return ",\n".join(parts)


@query("adaptive_downsample", f"""with {POINTS}, {UAV}, o as (select tile_id, min(x) as x0, min(y) as y0, min(z) as z0 from uav group by 1),
{_bisect_sql(300, 20.0, 10, 0.5)},
{_growth_sql(300, 0.5, 's10', 24)}, nn as (select tile_id, count(*) as n from uav group by 1),
big as (select u.*, best / 100 as size from uav u join nn using (tile_id) join g24 using (tile_id) where n > 300),
{_thinned_sql('size', 0.5, 'big')}
select tile_id, pid, {rr('x', 'y', 'z')} from bs union all select tile_id, pid, {rr('x', 'y', 'z')} from uav join nn using (tile_id) where n <= 300""")
def adaptive_downsample(spark, d):
    return vx.adaptive_downsample(_uav(spark, d), 300, 20.0, 0.5)


@query("downsample_with_masks", f"""with {POINTS}, {UAV}, o as (select tile_id, min(x) as x0, min(y) as y0, min(z) as z0 from uav group by 1),
{_bisect_sql(300, 20.0, 10, 0.5)},
{_growth_sql(300, 0.5, 's10', 24)}, nn as (select tile_id, count(*) as n from uav group by 1),
big as (select u.*, best / 100 as size from uav u join nn using (tile_id) join g24 using (tile_id) where n > 300),
{_thinned_sql('size', 0.5, 'big')},
every as (select * from bs union all select uav.* from uav join nn using (tile_id) where n <= 300)
select tile_id, pid, {rr('x', 'y', 'z')} from every where not (substr(tile_id, 6)::int % 3 = 1 and pid % 2 = 1)""")
def downsample_with_masks(spark, d):
    # Tiles of three kinds: with a valid mask (of which every other point was struck out by hand), with a
    # mask of an earlier cloud, and with masks of another cap only.
    uav = _uav(spark, d)
    kind = F.substring("tile_id", 6, 9).cast("int") % 3
    none = spark.createDataFrame([], sp.MASKS)
    valid = vx.downsample_with_masks(uav.where(kind == 1), none, 300, 20.0, 0.5)[1].where("pid % 2 = 0")
    stale = vx.downsample_with_masks(uav.where((kind == 0) & (F.col("z") < 12)), none, 300, 20.0, 0.5)[1]
    other = vx.downsample_with_masks(uav.where(kind == 2), none, 200, 20.0, 0.5)[1]
    stored = valid.unionByName(stale).unionByName(other)
    return vx.downsample_with_masks(uav, stored, 300, 20.0, 0.5)[0]


def _cap_sql(tag: str, most: int, start: str, passes: int = 24) -> str:
    """V3's search for one cap, from the sizes ``start`` (tile_id, lo); ``<tag>k`` has the points kept."""
    parts = [f"{tag}0 as (select tile_id, lo, lo * 10 as hi, null::double as best, null::bigint as bn from {start} join nn using (tile_id) where n > {most})"]
    for i in range(10):
        parts.append(
            f"{tag}n{i} as (select tile_id, count(distinct (floor((x - x0) / ((lo + hi) / 2 / 100)), floor((y - y0) / ((lo + hi) / 2 / 100)), "
            f"floor((z - z0) / ((lo + hi) / 2 / 100)))) as n from uav join o using (tile_id) join {tag}{i} using (tile_id) where hi - lo > 0.5 group by 1)"
        )
        parts.append(
            f"{tag}{i + 1} as (select tile_id, case when n > {most} then (lo + hi) / 2 else lo end as lo, case when n <= {most} then (lo + hi) / 2 else hi end as hi, "
            f"case when n <= {most} and (bn is null or n > bn) then (lo + hi) / 2 else best end as best, "
            f"case when n <= {most} and (bn is null or n > bn) then n else bn end as bn from {tag}{i} left join {tag}n{i} using (tile_id))"
        )
    parts.append(f"{tag}g0 as (select tile_id, lo as cur, best from {tag}10)")
    for i in range(passes):
        parts.append(
            f"{tag}m{i} as (select tile_id, count(distinct (floor((x - x0) / (cur / 100)), floor((y - y0) / (cur / 100)), "
            f"floor((z - z0) / (cur / 100)))) as n from uav join o using (tile_id) join {tag}g{i} using (tile_id) where best is null group by 1)"
        )
        parts.append(
            f"{tag}g{i + 1} as (select tile_id, case when n > {most} then cur + 2.0 * (n::double / {most}.0::double) else cur end as cur, "
            f"case when n <= {most} then cur else best end as best from {tag}g{i} left join {tag}m{i} using (tile_id))"
        )
    thinned = _thinned_sql("size", 1.0, f"{tag}b").replace("vx as", f"{tag}v as", 1).replace("ct as", f"{tag}c as", 1).replace("bs as", f"{tag}t as", 1)
    thinned = thinned.replace("from vx group", f"from {tag}v group").replace("from vx join ct", f"from {tag}v join {tag}c")
    parts.append(f"{tag}b as (select u.*, best / 100 as size from uav u join {tag}g{passes} using (tile_id))")
    parts.append(thinned)
    parts.append(f"{tag}s as (select tile_id, coalesce(best, lo) as lo from {start} left join {tag}g{passes} using (tile_id))")
    parts.append(f"{tag}k as (select tile_id, pid from {tag}t union all select tile_id, pid from uav join nn using (tile_id) where n <= {most})")
    return ",\n".join(parts)


@query("downsample_to_caps", f"""with {POINTS}, {UAV}, o as (select tile_id, min(x) as x0, min(y) as y0, min(z) as z0 from uav group by 1),
nn as (select tile_id, count(*) as n from uav group by 1), st as (select tile_id, 20.0::double as lo from nn),
{_cap_sql('p', 400, 'st')},
{_cap_sql('q', 200, 'ps')}
select tile_id, (select count(*) from pk k where k.tile_id = nn.tile_id) as n_400, (select count(*) from qk k where k.tile_id = nn.tile_id) as n_200 from nn""")
def downsample_to_caps(spark, d):
    flags = vx.downsample_to_caps(_uav(spark, d), [200, 400], 20.0)
    return flags.groupBy("tile_id").agg(
        F.count(F.when(F.col("keep_400"), 1)).alias("n_400"), F.count(F.when(F.col("keep_200"), 1)).alias("n_200")
    )


@query("octree_lowest", f"""with {POINTS}, {UAV}, o as (select tile_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from uav group by 1),
c as (select u.*, least(floor((x - x0) / (x1 - x0) * 4), 3) as a, least(floor((y - y0) / (y1 - y0) * 4), 3) as b, least(floor((z - z0) / (z1 - z0) * 4), 3) as c from uav u join o using (tile_id))
select tile_id, pid, {rr('x', 'y', 'z')} from c qualify row_number() over (partition by tile_id, a, b, c order by z, x, y, pid) = 1""")
def octree_lowest(spark, d):
    return vx.octree_lowest(_uav(spark, d), 2)


CHECKED = f"""{COVER},
counts as (select tile_id, count(*) filter (where cloud = 'uav') as n_uav, count(*) filter (where cloud = 'dep') as n_dep from points group by 1),
ck as (select t.*, case when n_uav < 480 then 'few_uav' when coverage_pct < 56 then 'low_coverage' when n_dep < 60 then 'few_dep'
   when n_uav / n_dep::double < 5 then 'low_ratio' end as reason_code from tiles t join counts using (tile_id) join cover using (tile_id))"""


def _checked(spark, d):
    local = q.validate_tiles(b.local_tiles(spark, d), b.points(spark, d), 480, 60, 56.0, 5, 5.0)
    placed = b.tiles(spark, d).select("tile_id", "xmin", "ymin", "xmax", "ymax")
    return placed.join(local.select("tile_id", "is_valid", "reason_code"), "tile_id")


_SPLIT = f"""vt as (select * from ck where reason_code is null), {_poly_sql(True, 'vt')},
held as (select distinct tile_id from hit),
te as (select tile_id from held qualify row_number() over (order by {draw("'123'", 'tile_id')}, tile_id) <= cast(trunc((select count(*) from held) * 0.6) as bigint)),
sp as (select tile_id, case when reason_code is not null then 'invalid' when tile_id in (select tile_id from te) then 'test'
  when tile_id in (select tile_id from held) then 'val' else 'train' end as split, reason_code from ck)"""


@query("polygon_split", f"with {POINTS}, {TILES}, {POLYS}, {CHECKED}, {_SPLIT} select tile_id, split, reason_code from sp")
def polygon_split(spark, d):
    return sp.split_tiles(_checked(spark, d), b.polygons(spark, d), 12.0, 0.6, "123")


@query("split_statistics", f"with {POINTS}, {TILES}, {POLYS}, {CHECKED}, {_SPLIT} select split, reason_code, count(*) as n_tiles from sp group by 1, 2")
def split_statistics(spark, d):
    return sp.split_statistics(sp.split_tiles(_checked(spark, d), b.polygons(spark, d), 12.0, 0.6, "123"))


@query("random_part", f"""with n as (select 'tile_' || cast(p_partkey as varchar) as tile_id from part)
select tile_id from n qualify row_number() over (order by {draw("'5'", 'tile_id')}, tile_id) <= cast(trunc((select count(*) from n) * 0.35) as bigint)""")
def random_part(spark, d):
    return sp.random_part(b.evaluation(spark, d).select("tile_id"), 0.35, "5")


@query("datasets_together", f"""with {POINTS}, {TILES}, {POLYS}, {CHECKED}, {_SPLIT}
select split, count(*) as n from (select tile_id, split from sp where split <> 'invalid' union all select tile_id || '_aug_0', 'train' from sp where split = 'train') group by 1""")
def datasets_together(spark, d):
    split = polygon_split(spark, d).where("split <> 'invalid'").select("tile_id", "split")
    extra = split.where("split = 'train'").withColumn("tile_id", F.concat("tile_id", F.lit("_aug_0")))
    return split.unionByName(extra).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("assembled_tiles", f"""with {POINTS}, {PIXELS}, {TILES},
c as (select tile_id, count(*) filter (where cloud = 'uav') as n_uav, count(*) filter (where cloud = 'dep') as n_dep from points group by 1),
i as (select tile_id, count(distinct image_id) filter (where sensor = 'naip') as n_naip, count(distinct image_id) filter (where sensor = 'uavsar') as n_uavsar from pixels group by 1)
select tile_id, n_uav, n_dep, n_naip, n_uavsar, coalesce(n_naip > 0, false) as has_naip, coalesce(n_uavsar > 0, false) as has_uavsar
from tiles left join c using (tile_id) left join i using (tile_id)""")
def assembled_tiles(spark, d):
    out = tb.assemble(b.tiles(spark, d).select("tile_id"), b.points(spark, d), b.pixels(spark, d))
    return out.select("tile_id", "n_uav", "n_dep", "n_naip", "n_uavsar", "has_naip", "has_uavsar")


@query("tile_build")
def tile_build(spark, d):
    world = b.world_points(spark, d)
    uav, dep = world.where("cloud = 'uav'").drop("cloud"), world.where("cloud = 'dep'").drop("cloud")
    points, log = tb.build_tiles(b.tiles(spark, d), uav, dep, 11.5, 600, 500, 20.0)
    counts = q.counts_by_cloud(points)
    return log.join(counts, "tile_id", "left").select("tile_id", "status", "reason", "n_uav", "n_dep")


@query("precomputed_tiles")
def precomputed_tiles(spark, d):
    out = sp.split_and_precompute(
        _local_checked(spark, d), _local_polys(spark, d), 12.0, b.points(spark, d), b.pixels(spark, d),
        ["intensity", "return_number"], "2024-01-15", max_sparse=80, max_dense=300, start_cm=20.0, k=4, cap_z=25.0,
    )
    pts = out["points"].groupBy("tile_id", "split").agg(
        F.count(F.when(F.col("cloud") == "dep", 1)).alias("n_dep"), F.count(F.when(F.col("cloud") == "uav", 1)).alias("n_uav")
    )
    edges = out["edges"].groupBy("tile_id").agg(F.count(F.lit(1)).alias("n_edges"))
    events = out["events"].groupBy("tile_id").agg(F.count_distinct("event_ix").alias("n_events"))
    return pts.join(edges, "tile_id", "left").join(events, "tile_id", "left")


def _local_checked(spark, d):
    return q.validate_tiles(b.local_tiles(spark, d), b.points(spark, d), 480, 60, 56.0, 5, 5.0)


def _local_polys(spark, d):
    return b.polygons(spark, d)


_MODELS = ("dep", "pred_baseline", "pred_combined")
_EVALUATED = f"""shifted as (select tile_id, 'dep' as m, pid, x, y, z from points where cloud = 'dep'
  union all select tile_id, 'pred_baseline', pid, x + (tax - 0.04) * 1.0::double, y + (tax - 0.04) * 1.0::double, z + (tax - 0.04) * 1.0::double from points where cloud = 'uav'
  union all select tile_id, 'pred_combined', pid, x + (tax - 0.04) * 0.5::double, y + (tax - 0.04) * 0.5::double, z + (tax - 0.04) * 0.5::double from points where cloud = 'uav'),
sides as (select distinct tile_id, m, 'ab' as side, pid, x - 5 as x, y - 5 as y, z from shifted
  union all select distinct tile_id, m, 'ba', pid, x - 5, y - 5, z from points, (select unnest({list(_MODELS)}) as m) where cloud = 'uav'),
nn as (select tile_id, m, side, x, y, z, b.d2 as d2, b.n_pid as n_pid, b.n_x as n_x, b.n_y as n_y, b.n_z as n_z from (
  select p.tile_id, p.m, p.side, p.pid, p.x, p.y, p.z, min({{'d2': (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z),
    'n_x': q.x, 'n_y': q.y, 'n_z': q.z, 'n_pid': q.pid}}) as b from sides p join sides q on p.tile_id = q.tile_id and p.m = q.m and p.side <> q.side group by all)),
cnt as (select tile_id, m, count(*) filter (where side = 'ab') as n_a, count(*) filter (where side = 'ba') as n_b from nn group by all),
cds as (select tile_id, m, sum(v) as cd from (select tile_id, m, side, avg(d2) as v from nn group by all) group by all),
load as (select *, count(*) over (partition by tile_id, m, side, n_pid, n_x, n_y, n_z) as q from nn),
dcs as (select tile_id, m, sum(v) * 0.5 as dcd from (select tile_id, m, side, avg(1 - exp(-sqrt(greatest(d2, 1e-12))) / (greatest((case when side = 'ab' then n_a else n_b end)::double
   / (case when side = 'ab' then n_b else n_a end) / (q + 1e-12), 1) + 1e-12)) as v from load join cnt using (tile_id, m) group by all) group by all),
ics as (select tile_id, m, sum(cd) + sum(3.0 / n_b * lse) as infocd from (select tile_id, m, side, sum(abs(x - n_x) + abs(y - n_y) + abs(z - n_z)) / (0.3 * count(*)) as cd,
   ln(sum(exp(-(abs(x - n_x) + abs(y - n_y) + abs(z - n_z)) / 0.3))) as lse from nn group by all) join cnt using (tile_id, m) group by all),
long as (select tile_id, m, cd, dcd, infocd, n_a::double as n from cds join dcs using (tile_id, m) join ics using (tile_id, m) join cnt using (tile_id, m)),
pc as (select tile_id, cloud, floor((x - 5 + 5) / 2) as c, floor((y - 5 + 5) / 2) as w, quantile_cont(z, 0.95) as q
  from points where z <= 50 and floor((x - 5 + 5) / 2) between 0 and 4 and floor((y - 5 + 5) / 2) between 0 and 4 group by 1, 2, 3, 4),
hc as (select tile_id, avg(q) filter (where cloud = 'dep') as a, avg(q) filter (where cloud = 'uav') as z from pc group by 1)"""


def _model_columns() -> str:
    names = (("cd", "chamfer_distance"), ("dcd", "dcd"), ("infocd", "infocd"), ("n", "point_count"))
    return ",\n  ".join(r(f"max({c}) filter (where m = '{m}')", f"{m}_{n}") for m in _MODELS for c, n in names)


@query("evaluation_frame", f"""with {POINTS}, {LOCAL_TILES}, {_EVALUATED}, wide as (select tile_id, {_model_columns()}, 'dep' as reference_model from long group by 1)
select wide.*, {r('a', 'input_mean_pct95_z')}, {r('hc.z', 'gt_mean_pct95_z')}, {r('hc.z - a', 'net_canopy_height_change')}, {rr('xmin', 'ymin', 'xmax', 'ymax')}
from wide left join hc using (tile_id) left join tiles using (tile_id)""")
def evaluation_frame(spark, d):
    pts = b.points(spark, d).select("tile_id", "cloud", "pid", "x", "y", "z", "tax")
    uav = pts.where("cloud = 'uav'")
    shifted = [
        uav.select("tile_id", F.lit(m).alias("cloud"), "pid", *[(F.col(c) + (F.col("tax") - 0.04) * s).alias(c) for c in "xyz"])
        for m, s in (("pred_baseline", 1.0), ("pred_combined", 0.5))
    ]
    clouds = pts.drop("tax").unionByName(shifted[0]).unionByName(shifted[1])
    clouds = clouds.withColumn("x", F.col("x") - 5).withColumn("y", F.col("y") - 5)
    return ev.evaluation_frame(clouds, b.local_tiles(spark, d), "uav", ["dep", "pred_baseline", "pred_combined"])
