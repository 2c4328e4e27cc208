"""A family and W6: augmentation, expansion and sampling weights."""

from pyspark.sql import functions as F

from contract.base import PIXELS, POINTS, draw, finite, query, r, rr
from tileloom import bindings as b
from tileloom.operators import augment as a, ranks
from tileloom.operators.quality import augmentation_violations

COLS = ["tile_id", "pid", "x", "y", "z"]
UAV = "uav as (select * from points where cloud = 'uav')"
#: The sparse cloud under the same name: nearly all its tiles are below the floor of 100 points.
SPARSE = "uav as (select * from points where cloud = 'dep' and z < 12)"
XYZ = f"tile_id, pid, {rr('x', 'y', 'z')}"


def _uav(spark, d):
    return b.points(spark, d).where("cloud = 'uav'").select(*COLS)


def _sparse(spark, d):
    return b.points(spark, d).where("cloud = 'dep' and z < 12").select(*COLS)


def t(step: str) -> str:
    return draw("'42'", f"'{step}'", "tile_id")


def p(step: str) -> str:
    return draw("'42'", f"'{step}'", "tile_id", "pid")


def norm(step: str, *extra: str) -> str:
    keys = ["'42'", f"'{step}'", *(extra or ("tile_id", "pid"))]
    return f"(sqrt(-2.0 * ln(1.0 - {draw(*keys, chr(39) + 'r' + chr(39))})) * cos(2.0 * pi() * {draw(*keys, chr(39) + 'a' + chr(39))}))"


@query("augment_remove", f"""with {POINTS}, {UAV},
k as (select *, row_number() over (partition by tile_id order by {p('remove')}, x, y, z, pid) as rn, count(*) over (partition by tile_id) as n from uav)
select {XYZ} from k where rn <= greatest(least(cast(trunc(n * 0.75) as bigint), n), least(100, n))""")
def augment_remove(spark, d):
    return a.remove_points(_uav(spark, d), "42", 0.25)


@query("augment_add", f"""with {POINTS}, {UAV},
k as (select *, row_number() over (partition by tile_id order by {p('add')}, x, y, z, pid) as rn, count(*) over (partition by tile_id) as n from uav),
g as (select *, {norm('add_x')} as gx, {norm('add_y')} as gy, {norm('add_z')} as gz, {p('add_d')} * 0.5 as st from k where rn <= cast(trunc(n * 0.1) as bigint)),
m as (select tile_id, -1 - pid as pid, x + gx / (sqrt(gx * gx + gy * gy + gz * gz) + 1e-8) * st as x, y + gy / (sqrt(gx * gx + gy * gy + gz * gz) + 1e-8) * st as y,
  z + gz / (sqrt(gx * gx + gy * gy + gz * gz) + 1e-8) * st as z from g)
select {XYZ} from uav union all select {XYZ} from m""")
def augment_add(spark, d):
    return a.add_points(_uav(spark, d), "42", 0.1, 0.5)


_MASK = f"""c as (select tile_id, x as cx, y as cy from uav qualify row_number() over (partition by tile_id order by {p('mask0_centre')}, x, y, z, pid) = 1),
ins as (select u.* from uav u join c using (tile_id) where sqrt(pow(x - cx, 2) + pow(y - cy, 2)) < 1.0 + 4.0 * {t('mask0_radius')}),
rk as (select *, row_number() over (partition by tile_id order by {p('mask0')}, x, y, z, pid) as rn, count(*) over (partition by tile_id) as n from ins),
lost as (select tile_id, pid, x, y, z from rk where rn > n - cast(trunc(n * (0.7 + 0.3 * {t('mask0_share')})) as bigint)),
kept as (select * from uav u where not exists (select 1 from lost l where l.tile_id = u.tile_id and l.pid = u.pid and l.x = u.x and l.y = u.y and l.z = u.z))"""


def _floor_sql(step: str) -> str:
    return f"""sh as (select tile_id from (select u.tile_id, count(*) as n, (select count(*) from kept k where k.tile_id = u.tile_id) as k from uav u group by 1)
  where k < least(100, n)),
fl as (select * from uav where tile_id in (select tile_id from sh) qualify row_number() over (partition by tile_id order by {p(step + '_floor')}, x, y, z, pid) <= 100)
select {XYZ} from kept where tile_id not in (select tile_id from sh) union all select {XYZ} from fl"""


@query("augment_mask", f"with {POINTS}, {UAV}, {_MASK}, {_floor_sql('mask')}")
def augment_mask(spark, d):
    return a.mask_points(_uav(spark, d), "42", 1.0, 5.0)


@query("augment_mask_small", f"with {POINTS}, {SPARSE}, {_MASK}, {_floor_sql('mask')}")
def augment_mask_small(spark, d):
    return a.mask_points(_sparse(spark, d), "42", 1.0, 5.0)


_SLICE = f"""tp as (select tile_id, max(z) as top from uav group by 1),
bd as (select tile_id, top * 0.9 as reach, least(18.0, top * 0.9) as hi, least(12.0, least(18.0, top * 0.9)) as lo from tp),
b2 as (select tile_id, reach, lo + (hi - lo) * {t('slice_h')} as h from bd),
b3 as (select tile_id, h, greatest(reach - h, 0) * {t('slice_z')} as bottom from b2),
pl as (select u.*, z >= bottom and z <= bottom + h as hit from uav u join b3 using (tile_id)),
rk as (select *, row_number() over (partition by tile_id order by {p('slice')}, x, y, z, pid) as rn, count(*) over (partition by tile_id) as n from pl where hit),
kept as (select tile_id, pid, x, y, z from pl where not hit union all
  select tile_id, pid, x, y, z from rk where rn <= n - cast(trunc(n * (0.7 + 0.3 * {t('slice_share')})) as bigint))"""


@query("augment_slice", f"with {POINTS}, {UAV}, {_SLICE}, {_floor_sql('slice')}")
def augment_slice(spark, d):
    return a.remove_slice(_uav(spark, d), "42", 12.0, 18.0, 0.9)


@query("augment_slice_small", f"with {POINTS}, {SPARSE}, {_SLICE}, {_floor_sql('slice')}")
def augment_slice_small(spark, d):
    return a.remove_slice(_sparse(spark, d), "42", 12.0, 18.0, 0.9)


@query("augment_dates", f"""with {PIXELS}, im as (select distinct tile_id, sensor, image_id, cast(date_diff('day', date '2024-01-15', dt) as double) as rel from pixels)
select tile_id, sensor, image_id, {r('rel + (-30.0 + 60.0 * ' + draw("'42'", "'dates'", 'tile_id', 'sensor') + ')', 'rel_days')} from im""")
def augment_dates(spark, d):
    images = b.pixels(spark, d).select(
        "tile_id", "sensor", "image_id", F.date_diff("dt", F.lit("2024-01-15").cast("date")).cast("double").alias("rel_days")
    ).distinct()
    return a.shift_dates(images, "42")


@query("augment_attributes", f"""with {POINTS}, {UAV}
select tile_id, pid, {r(f"least(greatest((intensity / 50 - 0.5) * (0.9 + (1.1 - 0.9) * {t('scale_intensity')}) + (-0.1 + (0.1 + 0.1) * {t('shift_intensity')}), -1), 1)", 'intensity')},
  {r('least(greatest(return_number / 5, -1), 1)', 'return_number')} from uav""")
def augment_attributes(spark, d):
    pts = b.points(spark, d).where("cloud = 'uav'").selectExpr(
        "tile_id", "pid", "intensity / 50 - 0.5D as intensity", "return_number / 5 as return_number"
    )
    return a.scale_attributes(pts, "42", ["intensity", "return_number"])


def _angle():
    n = F.regexp_extract("tile_id", r"(\d+)", 1).cast("int")
    return (n % 4) * 90


@query("augment_rotate", f"""with {POINTS}, {UAV}, u as (select *, suppkey % 4 * 90 as ang from uav)
select tile_id, pid, {r('case ang when 90 then y when 180 then -x when 270 then -y else x end', 'x')},
  {r('case ang when 90 then -x when 180 then -y when 270 then x else y end', 'y')}, {r('z')} from u""")
def augment_rotate(spark, d):
    return a.rotate_points(_uav(spark, d), _angle())


@query("augment_rotate_pixels", f"""with {PIXELS}, u as (select *, user_id % 4 * 90 as ang from pixels)
select event_id, case ang when 90 then col when 180 then 3 - row when 270 then 3 - col else row end as row,
  case ang when 90 then 3 - row when 180 then 3 - col when 270 then row else col end as col from u""")
def augment_rotate_pixels(spark, d):
    return a.rotate_pixels(b.pixels(spark, d), _angle(), F.lit(4), F.lit(4)).select("event_id", "row", "col")


@query("augment_reflect", f"""with {POINTS}, {UAV}
select tile_id, pid, {r('case when suppkey % 3 in (0, 2) then -x else x end', 'x')}, {r('case when suppkey % 3 in (1, 2) then -y else y end', 'y')}, {r('z')} from uav""")
def augment_reflect(spark, d):
    return a.reflect_points(_uav(spark, d), _axis())


def _axis():
    n = F.regexp_extract("tile_id", r"(\d+)", 1).cast("int") % 3
    return F.when(n == 0, "x").when(n == 1, "y").otherwise("both")


@query("augment_reflect_pixels", f"""with {PIXELS}
select event_id, case when user_id % 3 in (0, 2) then 3 - col else col end as col, case when user_id % 3 in (1, 2) then 3 - row else row end as row from pixels""")
def augment_reflect_pixels(spark, d):
    return a.reflect_pixels(b.pixels(spark, d), _axis(), F.lit(4), F.lit(4)).select("event_id", "row", "col")


@query("augment_jitter", f"""with {POINTS}, {UAV}
select tile_id, pid, {r('x + ' + norm('jitter_x') + ' * 0.02', 'x')}, {r('y + ' + norm('jitter_y') + ' * 0.02', 'y')}, {r('z + ' + norm('jitter_z') + ' * 0.01', 'z')} from uav""")
def augment_jitter(spark, d):
    return a.jitter(_uav(spark, d), "42")


@query("augment_band_gains", f"""with {PIXELS}
select event_id, {r('v * (0.9 + (1.1 - 0.9) * ' + draw("'42'", "'gain'", 'tile_id', 'image_id', 'band') + ')', 'v')} from pixels where {finite('v')}""")
def augment_band_gains(spark, d):
    px = b.pixels(spark, d).where("not isnan(v) and v < double('Infinity')")
    return a.band_gains(px, "42").select("event_id", "v")


_BANDS = ["click", "view", "purchase", "error", "signup"]


@query("augment_gradient", f"""with {PIXELS}, u as (select *, 2 * pi() * {draw("'42'", "'ramp'", 'tile_id', 'image_id')} as ang,
   list_position(['click', 'view', 'purchase', 'error', 'signup'], band) - 1 as ix from pixels where {finite('v')})
select event_id, {r('v * (((-1 + col * 2 / 3.0::double) * cos(ang) + (-1 + row * 2 / 3.0::double) * sin(ang)) * 0.2 + 1) * (1 + 0.1 * ix / 5)', 'v')} from u""")
def augment_gradient(spark, d):
    px = b.pixels(spark, d).where("not isnan(v) and v < double('Infinity')")
    ix = F.array_position(F.array(*[F.lit(x) for x in _BANDS]), F.col("band")) - 1
    return a.optical_gradient(px, "42", 4, 4, ix, 5).select("event_id", "v")


@query("augment_speckle")
def augment_speckle(spark, d):
    px = b.pixels(spark, d).where("sensor = 'uavsar' and not isnan(v) and v < double('Infinity')")
    return a.radar_speckle(px, "42").select("event_id", "v")


@query("augment_sequence_pixels")
def augment_sequence_pixels(spark, d):
    draws = a.step_draws(b.pixels(spark, d).withColumn("pid", F.col("event_id")), "42")
    px = b.pixels(spark, d).where("not isnan(v) and v < double('Infinity')")
    return a.augment_pixels(px, "42", draws, 4, 4, _BANDS).select("event_id", "row", "col", "v")


@query("augment_sequence_dates", f"""with {PIXELS}, im as (select distinct tile_id, sensor, image_id, cast(date_diff('day', date '2024-01-15', dt) as double) as rel from pixels)
select tile_id, sensor, image_id, {r(f"rel + case when {t('do_shift_dates')} < 0.4 then -30.0 + 60.0 * {draw(chr(39) + '42' + chr(39), chr(39) + 'dates' + chr(39), 'tile_id', 'sensor')} else 0 end", 'rel_days')} from im""")
def augment_sequence_dates(spark, d):
    px = b.pixels(spark, d)
    images = px.select(
        "tile_id", "sensor", "image_id", F.date_diff("dt", F.lit("2024-01-15").cast("date")).cast("double").alias("rel_days")
    ).distinct()
    return a.augment_images(images, "42", a.step_draws(px, "42"))


_DO = {"rotate": 1.0, "reflect": 0.5, "mask_points": 0.5, "add_points": 0.2}


@query("augment_step_draws", f"""with {POINTS}, {UAV}, c as (select tile_id, count(*) as n from uav group by 1)
select tile_id, {t('do_rotate')} < 1.0 as do_rotate, {t('do_reflect')} < 0.5 as do_reflect,
  {t('do_mask_points')} < 0.5 * greatest(0.1, n / 6000.0::double) as do_mask_points, {t('do_add_points')} < 0.2 as do_add_points,
  [90, 180, 270][cast(floor({t('angle')} * 3) as int) + 1] as angle, ['x', 'y', 'both'][cast(floor({t('axis')} * 3) as int) + 1] as axis from c""")
def augment_step_draws(spark, d):
    return _draws(spark, d).select("tile_id", "do_rotate", "do_reflect", "do_mask_points", "do_add_points", "angle", "axis")


def _draws(spark, d):
    # the tile goes last among the keys of the two picks
    return a.step_draws(_uav(spark, d), "42")


@query("dynamic_probabilities", f"""with {POINTS}, {UAV}, c as (select tile_id, count(*) as n from uav group by 1),
s as (select *, greatest(0.1, least(1.0, (n - 480) / 100.0::double)) as s from c)
select tile_id, n, {r('0.5 * s', 'mask_points_probability')}, {r('0.1 * s', 'remove_points_ratio')}, {r('0.7 * case when n < 480 then s else 1 end', 'mask_min_removal_ratio')} from s""")
def dynamic_probabilities(spark, d):
    counts = _uav(spark, d).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
    config = {"mask_points_probability": 0.5, "remove_points_ratio": 0.1, "mask_min_removal_ratio": 0.7}
    return a.dynamic_probabilities(counts, config, 480.0, 580.0)


@query("copies_per_tile", f"""with {POINTS}, k as (select distinct tile_id from points)
select tile_id || '_aug_' || cast(i as varchar) as new_id, cast(i as int) as copy from k, (select unnest(range(3)) as i)""")
def copies_per_tile(spark, d):
    return a.copies_per_tile(b.points(spark, d).select("tile_id").distinct(), 3).select("new_id", "copy")


WEIGHTS = f"""kp as (select * from points where z <= 60),
sc0 as (select tile_id, (stddev_samp(x) filter (where cloud = 'uav') + stddev_samp(y) filter (where cloud = 'uav')) / 2 + stddev_samp(z) filter (where cloud = 'uav') as complexity,
  abs(stddev_samp(z) filter (where cloud = 'uav') - stddev_samp(z) filter (where cloud = 'dep')) as z_diff from kp group by 1),
q as (select quantile_cont(complexity, 0.99) as qc, quantile_cont(z_diff, 0.97) as qz, min(complexity) as mc, min(z_diff) as mz from sc0),
nm as (select s.*, (least(complexity, qc) - mc) / (qc - mc) as nc, (least(z_diff, qz) - mz) / (qz - mz) as nzd from sc0 s, q),
sm as (select sum(exp(nc / 0.1)) as a, sum(exp(nzd / 0.05)) as b from nm),
mx as (select nm.*, 0.9 * exp(nc / 0.1) / (a + 1e-10) + 0.1 * exp(nzd / 0.05) / (b + 1e-10) as raw from nm, sm),
wt as (select tile_id, complexity, z_diff, nc, nzd, raw / (select sum(raw) from mx) as p from mx)"""


def _weights(spark, d):
    return a.sampling_weights(a.tile_scores(b.points(spark, d)))


@query("sampling_weights", f"""with {POINTS}, {WEIGHTS}
select tile_id, {rr('complexity', 'z_diff')}, {r('nc', 'norm_complexity')}, {r('nzd', 'norm_z_diff')}, {r('p')} from wt""")
def sampling_weights(spark, d):
    return _weights(spark, d)


@query("weight_diagnostics", f"""with {POINTS}, {WEIGHTS}, qs as (select quantile_cont(p, [0.05, 0.25, 0.5, 0.75, 0.95]) as s, quantile_cont(z_diff, 0.95) as t, count(*) as n from wt)
select any_value(n) as n, {r('min(p)', 'p_min')}, {r('max(p)', 'p_max')}, {r('avg(p)', 'p_mean')}, count(*) filter (where z_diff >= t) as n_top,
  {r('min(p) * any_value(n)', 'min_to_uniform')}, {r('max(p) * any_value(n)', 'max_to_uniform')},
  {', '.join(r(f'any_value(s[{i + 1}]) * 500', f'expected_{k}') for i, k in enumerate(('p5', 'p25', 'p50', 'p75', 'p95')))},
  {r('sum(p) filter (where z_diff >= t) * 500', 'top_expected')}, {r('count(*) filter (where z_diff >= t) / any_value(n)::double * 500', 'top_uniform_expected')}
from wt, qs""")
def weight_diagnostics(spark, d):
    return a.weight_diagnostics(_weights(spark, d), 500)


@query("weighted_copies", f"""with {POINTS}, wq as (select tile_id, count(*) / (select count(*) from points)::double as p from points group by 1),
ex as (select tile_id, p * 250 / (select sum(p) from wq) as e, {draw("'42'", 'tile_id')} as u from wq),
cu as (select *, sum(e) over (order by u, tile_id) as upto from ex),
ct as (select tile_id, cast(floor(round(upto, 9) + {draw("'42'", "'start'")}) - floor(round(upto - e, 9) + {draw("'42'", "'start'")}) as int) as n from cu)
select tile_id || '_aug_' || cast(i as varchar) as new_id, cast(i as int) as copy from ct, (select unnest(range(40)) as i) where i < n""")
def weighted_copies(spark, d):
    pts = b.points(spark, d)
    whole = ranks.totals(pts, n=F.count(F.lit(1)))["n"]
    w = pts.groupBy("tile_id").agg(F.count(F.lit(1)).alias("c")).select("tile_id", (F.col("c") / whole).alias("p"))
    return a.weighted_copies(w, 250, "42").select("new_id", "copy")


@query("capped_copies", f"""with {POINTS}, {WEIGHTS},
so as (select tile_id, p, row_number() over (order by p desc, tile_id) - 1 as k, sum(p) over () as s, count(*) over () as n,
  coalesce(sum(p) over (order by p desc, tile_id rows between unbounded preceding and 1 preceding), 0) as above from wt),
fx as (select min_by((250 - 4 * k) / (s - above), k) as f from so where p * (250 - 4 * k) / (s - above) < 4),
ex as (select tile_id, case when 4 * n <= 250 then 4.0::double else least(p * f, 4.0::double) end as e, {draw("'42'", 'tile_id')} as u from so, fx),
cu as (select *, sum(e) over (order by u, tile_id) as upto from ex),
ct as (select tile_id, cast(floor(round(upto, 9) + {draw("'42'", "'start'")}) - floor(round(upto - e, 9) + {draw("'42'", "'start'")}) as int) as n from cu)
select tile_id || '_aug_' || cast(i as varchar) as new_id, tile_id, cast(i as int) as copy from ct, (select unnest(range(5)) as i) where i < n""")
def capped_copies(spark, d):
    return a.weighted_copies(_weights(spark, d).select("tile_id", "p"), 250, "42", cap=4)


@query("running_total", f"""with {POINTS}, s as (select tile_id, count(*)::double as n from points group by 1)
select tile_id, {r('sum(n) over (order by ' + draw("'9'", 'tile_id') + ', tile_id)', 'upto')} from s""")
def running_total(spark, d):
    sizes = b.points(spark, d).groupBy("tile_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return ranks.running_total(sizes, "n", "9", "tile_id", rows_per_bucket=7).select("tile_id", "upto")


@query("expanded_tiles", f"""with {POINTS}, {UAV}, e as (select tile_id || '_aug_' || cast(i as varchar) as tile_id, pid, x, y, z from uav, (select unnest(range(2)) as i)),
bad as (select tile_id from e group by 1 having count(*) < 500)
select tile_id, count(*) as n from e where tile_id not in (select tile_id from bad) group by 1""")
def expanded_tiles(spark, d):
    uav = _uav(spark, d).withColumn("intensity", F.lit(0.0)).withColumn("cloud", F.lit("dep"))
    copies = a.expand(uav, a.copies_per_tile(uav.select("tile_id").distinct(), 2))
    good = a.accepted(copies, augmentation_violations(copies, None, "dep", 500))
    return good.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))


@query("average_ranks", f"""with {POINTS}, k as (select distinct z, rank() over (order by z) + (count(*) over (partition by z) - 1) / 2.0 as rank, count(*) over (partition by z) as c from points)
select {r('z')}, {r('rank')}, c from k""")
def average_ranks(spark, d):
    rows = b.points(spark, d).select(F.lit(0).alias("g"), "z")
    return ranks.average_ranks(rows, ["g"], "z").select("z", "rank", "c")
