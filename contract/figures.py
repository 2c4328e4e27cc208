"""E, D and X16-X20 families: statistics, report rows, images and normalisation."""

from pyspark.sql import functions as F

from contract.base import CLOUD_POINTS, EVAL, LOCAL_TILES, PIXELS, POINTS, draw, finite, query, r, rr
from tileloom import bindings as b
from tileloom.functions import values as v
from tileloom.operators import imagery as im, normalize as nz, report as rp, stats as st

_MODELS = ("input", "baseline", "naip", "uavsar", "combined")
LONG = "lm as (" + " union all ".join(
    f"select tile_id, '{m}' as model, {m}_chamfer_distance as v from eval where {finite(m + '_chamfer_distance')}" for m in _MODELS
) + ")"
_PAIRS = [("baseline", "naip"), ("baseline", "uavsar"), ("naip", "combined")]
DIFF = "df as (" + " union all ".join(
    f"select '{o}_vs_{a}' as pair, {a}_chamfer_distance as base, {a}_chamfer_distance - {o}_chamfer_distance as d from eval "
    f"where {finite(a + '_chamfer_distance')} and {finite(o + '_chamfer_distance')}" for a, o in _PAIRS
) + ")"


@query("describe_models", f"""with {EVAL}, {LONG},
q as (select model, avg(v) as mean, stddev_samp(v) as std, count(*) as n, quantile_cont(v, [0.25, 0.5, 0.75]) as s from lm group by 1)
select model, {rr('mean', 'std')}, n, {r('s[1]', 'q25')}, {r('s[2]', 'median')}, {r('s[3]', 'q75')}, {r('s[3] - s[1]', 'iqr')} from q""")
def describe_models(spark, d):
    return st.describe(b.evaluation(spark, d))


@query("box_table", f"""with {EVAL}, {LONG}, q as (select model, quantile_cont(v, [0.25, 0.5, 0.75, 0.05, 0.95]) as s from lm group by 1)
select model, {r('s[1]', 'q25')}, {r('s[2]', 'median')}, {r('s[3]', 'q75')}, {r('s[4]', 'low')}, {r('s[5]', 'high')} from q""")
def box_table(spark, d):
    return st.box_table(b.evaluation(spark, d))


@query("paired_comparison", f"""with {EVAL}, {DIFF}
select pair, {r('quantile_cont(d, 0.5)', 'median_change')}, {r('100 * quantile_cont(d, 0.5) / quantile_cont(base, 0.5)', 'percent_change')},
  {r('(count(*) filter (where d > 0) - count(*) filter (where d < 0)) / count(*)::double', 'sign_effect')}, count(*) as n from df group by 1""")
def paired_comparison(spark, d):
    return st.paired(st.differences(b.evaluation(spark, d), _PAIRS))


def _two_sided(z: str) -> str:
    """The Chebyshev fit of erfc, in SQL."""
    x, poly = f"abs({z}) / sqrt(2.0)", "0.17087277"
    t = f"(1 / (1 + 0.5 * {x}))"
    for c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"):
        poly = f"({c} + {t} * {poly})"
    return f"{t} * exp(-({x}) * ({x}) + {poly})"


_Z = "(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48)"


@query("wilcoxon", f"""with {EVAL}, {DIFF}, nz as (select pair, sign(d) as s, abs(d) as a from df where d <> 0),
k as (select *, rank() over (partition by pair order by a) + (count(*) over (partition by pair, a) - 1) / 2.0 as rk,
   count(*) over (partition by pair, a) as t from nz),
s as (select pair, count(*) as n, sum(case when s > 0 then rk else 0 end) as w_plus, sum(case when s < 0 then rk else 0 end) as w_minus,
   sum(t::double * t - 1) as ties from k group by 1)
select pair, n, {r('w_plus')}, {r('w_minus')}, {r('least(w_plus, w_minus)', 'w')},
 {r('z')}, {r(_two_sided('z'), 'p_value')} from (select *, {_Z} as z from s)""")
def wilcoxon(spark, d):
    return st.wilcoxon(st.differences(b.evaluation(spark, d), _PAIRS))


_CLEAN = "cl as (select * from eval where " + " and ".join(
    finite(c) for c in ["net_canopy_height_change"] + [m + "_chamfer_distance" for m in _MODELS[1:]]
) + ")"


def _spearman_sql(group: str) -> str:
    avg = lambda c: f"rank() over (partition by grp order by {c}) + (count(*) over (partition by grp, {c}) - 1) / 2.0"
    ranks = ", ".join(f"{avg(m + '_chamfer_distance')} as r_{m}" for m in _MODELS[1:])
    rows = " union all ".join(
        f"select grp, '{m}' as model, corr(r_h, r_{m}) as rho, count(*) as n from rk group by 1" for m in _MODELS[1:]
    )
    return f"""{_CLEAN}, ga as (select {group} as grp, abs(net_canopy_height_change) as h, * from cl),
rk as (select grp, {avg('h')} as r_h, {ranks} from ga), rho as ({rows})"""


_SIDES = "case when net_canopy_height_change >= 0 then 'gains' else 'losses' end"


@query("spearman", f"with {EVAL}, {_spearman_sql(chr(39) + 'all' + chr(39))} select grp, model, {r('rho')}, n from rho")
def spearman(spark, d):
    return st.spearman(b.evaluation(spark, d))


_FISHER = f"""select grp, model, {r('rho')}, n, {r('z')}, {r(_two_sided('z'), 'p_z')} from (
select o.grp, o.model, o.rho, o.n, (atanh(b.rho) - atanh(o.rho)) / sqrt(2.0 / (o.n - 3)) as z
from rho o join rho b on o.grp = b.grp and b.model = 'baseline' where o.model <> 'baseline')"""


@query("fisher_comparison", f"with {EVAL}, {_spearman_sql(chr(39) + 'all' + chr(39))} {_FISHER}")
def fisher_comparison(spark, d):
    return st.compare_correlations(st.spearman(b.evaluation(spark, d)))


@query("gains_losses_comparison", f"with {EVAL}, {_spearman_sql(_SIDES)} {_FISHER}")
def gains_losses_comparison(spark, d):
    rhos = st.spearman(b.evaluation(spark, d), group=st.gains_and_losses())
    return st.compare_correlations(rhos)


@query("winsorised", f"""with {EVAL}, {_CLEAN},
q as (select quantile_cont(baseline_chamfer_distance, 0.95) as qb, quantile_cont(combined_chamfer_distance, 0.95) as qc,
  quantile_cont(net_canopy_height_change, 0.9) filter (where net_canopy_height_change >= 0) as qg,
  quantile_cont(abs(net_canopy_height_change), 0.9) filter (where net_canopy_height_change < 0) as ql
  from eval where {finite('baseline_chamfer_distance')} and {finite('combined_chamfer_distance')})
select tile_id, {r('least(baseline_chamfer_distance, qb)', 'baseline')}, {r('least(combined_chamfer_distance, qc)', 'fused')},
  {r('case when net_canopy_height_change >= 0 then least(net_canopy_height_change, qg) else greatest(net_canopy_height_change, -ql) end', 'change')}
from eval, q where {finite('baseline_chamfer_distance')} and {finite('combined_chamfer_distance')}""")
def winsorised(spark, d):
    out = st.winsorise(b.evaluation(spark, d), ("baseline", "combined"), 95.0, 90.0)
    return out.select(
        "tile_id", F.col("baseline_chamfer_distance").alias("baseline"),
        F.col("combined_chamfer_distance").alias("fused"), F.col("net_canopy_height_change").alias("change"),
    )


@query("report_samples", f"""with {EVAL}, rw as (select tile_id, combined_chamfer_distance as loss, input_chamfer_distance / combined_chamfer_distance as ratio
   from eval where not isnan(combined_chamfer_distance)),
a as (select * from rw order by loss desc, tile_id limit 20), l as (select * from rw order by ratio, tile_id limit 20),
h as (select * from rw order by ratio desc, tile_id limit 20),
rest as (select * from rw where tile_id not in (select tile_id from a union all select tile_id from l union all select tile_id from h)),
z as (select * from rest order by {draw("'7'", 'tile_id')}, tile_id limit 20)
select tile_id, 'high_loss' as list, {r('ratio')} from a union all select tile_id, 'low_improvement', {r('ratio')} from l
union all select tile_id, 'high_improvement', {r('ratio')} from h union all select tile_id, 'random', {r('ratio')} from z""")
def report_samples(spark, d):
    return rp.report_samples(b.evaluation(spark, d), "combined", 20, 20, 20, 20, "7").select("tile_id", "list", "ratio")


@query("interesting_tiles", f"""with {EVAL}, md as (select quantile_cont(gt_z_std, 0.5) as m from eval),
rw as (select *, gt_max_z > 10 and gt_z_std > m as tall from eval, md where not isnan(combined_chamfer_distance)),
a as (select tile_id, 0 as list_ix, row_number() over (order by -baseline_chamfer_distance / combined_chamfer_distance, tile_id) as pos from rw),
c as (select tile_id, 1 as list_ix, row_number() over (order by combined_chamfer_distance, tile_id) as pos from rw where tall),
e as (select tile_id, 2 as list_ix, row_number() over (order by -input_chamfer_distance / combined_chamfer_distance, tile_id) as pos
  from rw where tall and input_chamfer_distance < 2),
al as (select * from a where pos <= 100 union all select * from c where pos <= 100 union all select * from e where pos <= 100)
select tile_id, cast(list_ix as int) as list_ix, cast(pos as int) as pos from al qualify row_number() over (partition by tile_id order by list_ix, pos) = 1""")
def interesting_tiles(spark, d):
    return rp.interesting_tiles(b.evaluation(spark, d))


@query("rank_thresholds", f"""with {EVAL}, rw as (select input_chamfer_distance / baseline_chamfer_distance as v from eval)
select (select count(*) from rw) as n, {r('(select max(v) from (select v from rw order by v limit 30))', 'low_threshold')},
  {r('(select min(v) from (select v from rw order by v desc limit 30))', 'high_threshold')}""")
def rank_thresholds(spark, d):
    ratio = F.col("input_chamfer_distance") / F.col("baseline_chamfer_distance")
    return rp.rank_thresholds(b.evaluation(spark, d), ratio)


@query("report_overview", f"""with {EVAL} select count(*) as n_samples, {r('avg(net_canopy_height_change)', 'mean_net_canopy_height_change')},
  {r('avg(input_chamfer_distance)', 'mean_input_chamfer_distance')} from eval""")
def report_overview(spark, d):
    return rp.overview(b.evaluation(spark, d), ["net_canopy_height_change", "input_chamfer_distance"])


@query("loss_summary", f"""with {EVAL}, f as (select tile_id, combined_chamfer_distance as v from eval where {finite('combined_chamfer_distance')})
select {r('avg(v)', 'mean_loss')}, {r('min(v)', 'min_loss')}, (select tile_id from f order by v, tile_id limit 1) as min_tile,
  {r('max(v)', 'max_loss')}, (select tile_id from f order by v desc, tile_id desc limit 1) as max_tile from f""")
def loss_summary(spark, d):
    return rp.loss_summary(b.evaluation(spark, d), "combined_chamfer_distance")


@query("samples_by_model", f"""with {EVAL}, {LONG}, mt as (select tile_id, model, v, v * 2 as w from lm where not (model = 'baseline' and v > 3.5))
select tile_id, {r("max(v) filter (where model = 'baseline')", 'baseline_cd')}, {r("max(w) filter (where model = 'baseline')", 'baseline_dcd')},
  {r("max(v) filter (where model = 'combined')", 'combined_cd')}, {r("max(w) filter (where model = 'combined')", 'combined_dcd')},
  case when count(*) filter (where model = 'baseline') > 0 then 'baseline' else 'combined' end as reference_model
from mt where model in ('baseline', 'combined') group by 1""")
def samples_by_model(spark, d):
    rows = st.long_metrics(b.evaluation(spark, d), ("baseline", "combined")).where("v is not null")
    rows = rows.where("not (model = 'baseline' and v > 3.5)")
    both = rows.withColumn("metric", F.lit("cd")).unionByName(
        rows.withColumn("v", F.col("v") * 2).withColumn("metric", F.lit("dcd"))
    )
    return rp.samples_by_model(both, ["baseline", "combined"], ["cd", "dcd"])


@query("balanced_shards", f"""with {POINTS}, s as (select tile_id, count(*) as size from points group by 1),
k as (select *, row_number() over (order by size desc, floor({draw("'shard'", 'tile_id')} * 4096), tile_id) - 1 as ix from s)
select tile_id, size, cast(case when ix % 14 < 7 then ix % 14 else 13 - ix % 14 end as int) as shard from k""")
def balanced_shards(spark, d):
    return rp.balanced_shards(b.points(spark, d).groupBy("tile_id").agg(F.count(F.lit(1)).alias("size")), 7)


@query("shard_report", f"""with {POINTS}, s as (select tile_id, count(*) as size from points group by 1),
k as (select *, row_number() over (order by size desc, floor({draw("'shard'", 'tile_id')} * 4096), tile_id) - 1 as ix from s),
per as (select case when ix % 14 < 7 then ix % 14 else 13 - ix % 14 end as shard, cast(sum(size) as bigint) as total, count(*) as n_tiles from k group by 1)
select min(total) as min_total, max(total) as max_total, {r('avg(total)', 'avg_total')}, min(n_tiles) as min_tiles, max(n_tiles) as max_tiles from per""")
def shard_report(spark, d):
    return rp.shard_report(balanced_shards(spark, d))


# --- images ------------------------------------------------------------------

IMAGES = """im as (select distinct tile_id, image_id, dt from pixels where sensor = 'uavsar'),
dy as (select distinct tile_id, dt from im),
sg as (select *, case when date_diff('day', lag(dt) over (partition by tile_id order by dt), dt) > 1 then 1 else 0 end as s from dy),
ev as (select tile_id, dt, sum(s) over (partition by tile_id order by dt) as event_ix from sg),
ie as (select im.*, event_ix from im join ev using (tile_id, dt)),
sl as (select *, row_number() over (partition by tile_id, event_ix order by dt, image_id) as rn, count(*) over (partition by tile_id, event_ix) as n_images,
  min(dt) over (partition by tile_id, event_ix) as event_dt from ie)"""


def _images(spark, d):
    return b.pixels(spark, d).where("sensor = 'uavsar'").select("tile_id", "image_id", "dt").distinct()


@query("acquisition_events", f"with {PIXELS}, {IMAGES} select tile_id, image_id, dt, cast(event_ix as bigint) as event_ix from ie")
def acquisition_events(spark, d):
    return im.acquisition_events(_images(spark, d), ["tile_id"]).select("tile_id", "image_id", "dt", "event_ix")


@query("event_slots", f"""with {PIXELS}, {IMAGES} select tile_id, image_id, cast(event_ix as bigint) as event_ix, cast(rn - 1 as int) as slot, n_images, event_dt
from sl where n_images >= 2 and rn <= 8""")
def event_slots(spark, d):
    events = im.acquisition_events(_images(spark, d), ["tile_id"])
    return im.event_slots(events, ["tile_id"]).select("tile_id", "image_id", "event_ix", "slot", "n_images", "event_dt")


@query("attention_masks", f"""with {PIXELS}, {IMAGES} select tile_id, cast(event_ix as bigint) as event_ix, event_dt,
  array_to_string([i < least(max(n_images), 8) for i in range(8)], ',') as mask from sl where n_images >= 2 group by 1, 2, 3""")
def attention_masks(spark, d):
    slots = im.event_slots(im.acquisition_events(_images(spark, d), ["tile_id"]), ["tile_id"])
    masks = im.attention_masks(slots, ["tile_id"])
    text = F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), ",")
    return masks.select("tile_id", "event_ix", "event_dt", text.alias("mask"))


_PX = "px as (select tile_id, image_id, band, row, col, dt, avg(v) as v from pixels where not isnan(v) and not isinf(v) group by all)"


def _one_pixel_each(spark, d):
    rows = b.pixels(spark, d).where("not isnan(v) and v < double('Infinity')")
    return rows.groupBy("tile_id", "image_id", "band", "row", "col", "dt").agg(F.avg("v").alias("v"))


@query("image_change", f"""with {PIXELS}, {_PX},
l as (select *, v - lag(v) over w as dv, date_diff('day', lag(dt) over w, dt) as gap from px window w as (partition by tile_id, band, row, col order by dt, image_id)),
mx as (select tile_id, max(abs(gap)) as m from l group by 1)
select tile_id, image_id, band, row, col, {r('dv')}, {r('gap / (m + 1e-6)', 'gap_scaled')} from l join mx using (tile_id) where gap is not null""")
def image_change(spark, d):
    out = im.change_between_images(_one_pixel_each(spark, d), ["tile_id", "band", "row", "col"])
    return out.select("tile_id", "image_id", "band", "row", "col", "dv", "gap_scaled")


@query("contrast_stretch", f"""with {PIXELS}, fin as (select *, not isnan(v) and not isinf(v) as ok from pixels),
q as (select tile_id, quantile_cont(v, [0.02, 0.98]) as s from fin where v > 0 and ok group by 1)
select event_id, {r('coalesce(case when ok and s[2] - s[1] <> 0 then least(greatest((v - s[1]) / (s[2] - s[1]), 0), 1) * 255 end, 0)', 'level')}
from fin left join q using (tile_id)""")
def contrast_stretch(spark, d):
    return im.stretch(b.pixels(spark, d), ["tile_id"]).select("event_id", "level")


def _regrid_sql(method: str) -> str:
    if method == "nearest":
        pick = "sr = cast(floor(fy + 0.5) as int) and sc = cast(floor(fx + 0.5) as int)"
        w = "1.0"
    elif method == "cubic":
        pick = "sr between cast(floor(fy) as int) - 1 and cast(floor(fy) as int) + 2 and sc between cast(floor(fx) as int) - 1 and cast(floor(fx) as int) + 2"
        k = lambda s: f"(case when {s} <= 1 then 1.5 * pow({s}, 3) - 2.5 * pow({s}, 2) + 1 when {s} < 2 then -0.5 * pow({s}, 3) + 2.5 * pow({s}, 2) - 4 * {s} + 2 else 0 end)"
        w = f"{k('abs(fy - sr)')} * {k('abs(fx - sc)')}"
    else:
        pick = "sr in (cast(floor(fy) as int), cast(floor(fy) as int) + 1) and sc in (cast(floor(fx) as int), cast(floor(fx) as int) + 1)"
        w = "greatest(1 - abs(fy - sr), 0) * greatest(1 - abs(fx - sc), 0)"
    return f"""with {CLOUD_POINTS}, src as (select tile_id, cast(trunc(y / 2) as int) as sr, cast(trunc(x / 2) as int) as sc, avg(z) as v
  from points where x < 10 and y < 10 group by 1, 2, 3),
ax as (select i from (select unnest(range(7)) as i)),
tg as (select t.tile_id, a.i as row, c.i as col, (0.3 + (c.i + 0.5) * 1.3) / 2 - 0.5 as fx, (10 - (9.1 - (a.i + 0.5) * 1.3)) / 2 - 0.5 as fy
  from (select distinct tile_id from src) t, ax a, ax c),
j as (select tg.tile_id, row, col, v, {w} as w from tg left join src on src.tile_id = tg.tile_id and {pick})
select tile_id, cast(row as int) as row, cast(col as int) as col, {r('coalesce(sum(w * v) / nullif(sum(case when v is not null then w end), 0), -9)', 'v')}
from j group by 1, 2, 3"""


def _regrid(spark, d, method):
    src = b.cloud_points(spark, d).where("x < 10 and y < 10").groupBy(
        "tile_id", (F.col("y") / 2).cast("int").alias("row"), (F.col("x") / 2).cast("int").alias("col")
    ).agg(F.avg("z").alias("v"))
    return im.regrid(src, ["tile_id"], (0.0, 10.0, 2.0), (0.3, 0.4, 9.1, 9.1), 1.3, method, -9.0)


@query("regrid_nearest", _regrid_sql("nearest"))
def regrid_nearest(spark, d):
    return _regrid(spark, d, "nearest")


@query("regrid_bilinear", _regrid_sql("bilinear"))
def regrid_bilinear(spark, d):
    return _regrid(spark, d, "bilinear")


@query("regrid_cubic", _regrid_sql("cubic"))
def regrid_cubic(spark, d):
    return _regrid(spark, d, "cubic")


@query("band_statistics", f"""with {PIXELS}
select sensor, band, {r(f"avg(v) filter (where {finite('v')})", 'mean')}, {r(f"stddev_pop(v) filter (where {finite('v')})", 'std')},
  count(*) filter (where {finite('v')}) as n, count(*) filter (where isnan(v)) as n_nan, count(*) filter (where isinf(v)) as n_inf from pixels group by 1, 2""")
def band_statistics(spark, d):
    return nz.value_statistics(b.pixels(spark, d), ["sensor", "band"])


@query("attribute_statistics", f"""with {POINTS}, l as (select 'intensity' as band, intensity as v from points union all
  select 'return_number', return_number from points union all select 'number_of_returns', number_of_returns from points)
select 'point' as kind, band, {r('avg(v)', 'mean')}, {r('case when stddev_pop(v) < 1e-6 then 1 else stddev_pop(v) end', 'std')}, count(*) as n,
  0::bigint as n_nan, 0::bigint as n_inf from l group by 1, 2""")
def attribute_statistics(spark, d):
    return nz.attribute_statistics(b.points(spark, d), ["intensity", "return_number", "number_of_returns"])


STAT = f"""sb as (select band, avg(v) as mean, stddev_pop(v) as std from pixels where {finite('v')} group by 1)"""


@query("optical_scaling", f"""with {PIXELS}, {STAT} select event_id, {r(f"case when {finite('v')} then v / 255 else 0 end", 'norm')},
  {r(f"case when {finite('v')} then (v - mean) / std else 0 end", 'z')} from pixels join sb using (band)""")
def optical_scaling(spark, d):
    px = b.pixels(spark, d)
    scored = nz.standardise_optical(px, nz.value_statistics(px, ["band"])).withColumnRenamed("norm", "z")
    return nz.scale_optical(scored).select("event_id", "norm", "z")


@query("radar_scaling", f"""with {PIXELS}, {STAT} select event_id, {r(f"case when {finite('v')} then (v - mean) / std else 0 end", 'norm')},
  not {finite('v')} as is_invalid from pixels join sb using (band)""")
def radar_scaling(spark, d):
    px = b.pixels(spark, d)
    return nz.standardise_radar(px, nz.value_statistics(px, ["band"])).select("event_id", "norm", "is_invalid")


@query("attribute_scaling", f"""with {POINTS}, s as (select avg(intensity) as m, stddev_pop(intensity) as s from points)
select pid, round(cast((intensity - m) / s as double), 4) + 0.0 as norm from points, s""")
def attribute_scaling(spark, d):
    p = b.points(spark, d)
    out = nz.standardise_attributes(p, ["intensity"], nz.attribute_statistics(p, ["intensity"]))
    return out.select("pid", F.round(F.col("intensity_norm").cast("double"), 4).alias("norm"))


@query("box_normalisation", f"""with {POINTS}, m as (select tile_id, min(z) as z0 from points group by 1)
select tile_id, pid, {r('(x - 5) / 1.0', 'x_norm')}, {r('y - 5', 'y_norm')}, {r('z - z0', 'z_norm')} from points join m using (tile_id)""")
def box_normalisation(spark, d):
    out = nz.normalise_to_box(b.points(spark, d), b.local_tiles(spark, d))
    return out.select("tile_id", "pid", "x_norm", "y_norm", "z_norm")


@query("radius_normalisation", f"""with {POINTS}, m as (select tile_id, avg(x) as cx, avg(y) as cy, avg(z) as cz from points group by 1),
s as (select tile_id, max(sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))) as s from points join m using (tile_id) group by 1)
select tile_id, pid, {r('(x - cx) / s', 'x_norm')}, {r('(z - cz) / s', 'z_norm')} from points join m using (tile_id) join s using (tile_id)""")
def radius_normalisation(spark, d):
    out = nz.normalise_to_radius(b.points(spark, d))
    return out.select("tile_id", "pid", "x_norm", "z_norm")


@query("extent_normalisation", f"""with {POINTS}, m as (select tile_id, avg(z) as cz, greatest(10, max(z) - min(z)) as s from points group by 1)
select tile_id, pid, {r('(y - 5) / s', 'y_norm')}, {r('(z - cz) / s', 'z_norm')} from points join m using (tile_id)""")
def extent_normalisation(spark, d):
    out = nz.normalise_to_extent(b.points(spark, d), b.local_tiles(spark, d))
    return out.select("tile_id", "pid", "y_norm", "z_norm")


_BANDS = "bt(band, cal, bw, irr) as (values ('click', 0.0091, 0.05, 1974.241), ('view', 0.0072, 0.063, 1856.41), ('purchase', 0.0113, 0.057, 1559.455), ('error', 0.0085, 0.1, 861.286), ('signup', 0.0101, 0.04, 1069.73))"


@query("reflectance", f"""with {PIXELS}, {_BANDS},
rf as (select event_id, band, pi() * (v * cal / bw) * pow(1 - 0.01672 * cos(radians(0.9856 * (dayofyear(dt) - 4))), 2) / (irr * cos(radians(90 - 42.5))) as v
  from pixels join bt using (band) where {finite('v')})
select event_id, band, {r('v', 'raw')}, {r('least(greatest(v, 0), 1)', 'reflectance')} from rf""")
def reflectance(spark, d):
    return _reflectance(spark, d).select("event_id", "band", F.col("v").alias("raw"), v.clip(F.col("v"), 0.0, 1.0).alias("reflectance"))


def _reflectance(spark, d):
    rows = [("click", 0.0091, 0.05, "blue"), ("view", 0.0072, 0.063, "green"), ("purchase", 0.0113, 0.057, "red"),
            ("error", 0.0085, 0.1, "nir2"), ("signup", 0.0101, 0.04, "nir1")]
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for row in rows for x in (row[0], row[i])]), F.col("band"))
    irr = F.element_at(F.create_map(*[F.lit(x) for row in rows for x in (row[0], v.SOLAR_IRRADIANCE[row[3]])]), F.col("band"))
    px = b.pixels(spark, d).where("not isnan(v) and v < double('Infinity')")
    value = v.reflectance(F.col("v"), pick(1), pick(2), irr, F.lit(42.5), v.earth_sun_distance(F.col("dt")))
    return px.select("event_id", "band", value.alias("v"))


@query("reflectance_percentiles", f"""with {PIXELS}, {_BANDS},
rf as (select band, pi() * (v * cal / bw) * pow(1 - 0.01672 * cos(radians(0.9856 * (dayofyear(dt) - 4))), 2) / (irr * cos(radians(90 - 42.5))) as v
  from pixels join bt using (band) where {finite('v')}), q as (select band, quantile_cont(v, [0.01, 0.5, 0.99]) as s from rf group by 1)
select band, {r('s[1]', 'p1')}, {r('s[2]', 'p50')}, {r('s[3]', 'p99')} from q""")
def reflectance_percentiles(spark, d):
    from tileloom.operators.ranks import named_percentiles

    return named_percentiles(_reflectance(spark, d), ["band"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99})
