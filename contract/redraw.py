"""A12 and A14 with their ways back: kept originals, copies drawn again."""

from pyspark.sql import functions as F

from contract.base import POINTS, draw, query, r, rr
from contract.nearest import _knn
from tileloom import bindings as b
from tileloom.operators import augment as a, redraw
from tileloom.operators.neighbors import edge_table
from tileloom.operators.quality import augmentation_violations

COLS = ["tile_id", "pid", "x", "y", "z", "intensity", "return_number"]
KEEP = "tile_id, pid, x, y, z, intensity, return_number"
ATTRIBUTES = ["intensity", "return_number"]
#: Tiles with fewer points after the sequence get their original back.
LEAST = 140


def t(step: str) -> str:
    return draw("'42'", f"'{step}'", "tile_id")


def p(step: str) -> str:
    return draw("'42'", f"'{step}'", "tile_id", "pid")


def norm(step: str) -> str:
    k = ("'42'", f"'{step}'", "tile_id", "pid")
    return f"(sqrt(-2.0 * ln(1.0 - {draw(*k, chr(39) + 'r' + chr(39))})) * cos(2.0 * pi() * {draw(*k, chr(39) + 'a' + chr(39))}))"


def ranked(source: str, step: str, where: str = "true") -> str:
    return f"select *, row_number() over (partition by tile_id order by {p(step)}, x, y, z, pid) as rn, count(*) over (partition by tile_id) as n from {source} where {where}"


def thinned(step: str, mark: str) -> str:
    """Of the marked rows the share that the step leaves."""
    return f"select {KEEP} from ({ranked(mark, step)}) where rn <= n - cast(trunc(n * (0.7 + (1.0 - 0.7) * {t(step + '_share')})) as bigint)"


def floored(name: str, before: str, kept: str, step: str) -> str:
    return f"""{name}_short as (select tile_id from (select tile_id, count(*) as n from {before} group by 1) left join (select tile_id, count(*) as k from {kept} group by 1) using (tile_id)
  where coalesce(k, 0) < least(100, n)),
{name} as (select {KEEP} from {kept} where tile_id not in (select tile_id from {name}_short)
  union all select {KEEP} from ({ranked(before, step + '_floor')}) where tile_id in (select tile_id from {name}_short) and rn <= 100)"""


def step_sql(name: str, before: str, do: str, body: str, made: str) -> str:
    """A step on the chosen tiles only; ``body`` defines ``made`` from ``<name>_in``."""
    return f"""{name}_in as (select {KEEP} from {before} join flags using (tile_id) where {do}),
{body},
{name} as (select {KEEP} from {before} join flags using (tile_id) where not {do} union all select {KEEP} from {made})"""


SMALL = "greatest(0.1, n / 6000.0::double)"
SEQUENCE = f"""src as (select {KEEP} from points where cloud = 'dep'),
flags as (select tile_id, {t('do_rotate')} < 1.0 as do_rotate, {t('do_reflect')} < 0.5 as do_reflect, {t('do_jitter')} < 0.3 as do_jitter,
  {t('do_attributes')} < 0.4 as do_attributes, {t('do_add_points')} < 0.2 as do_add, {t('do_remove_points')} < 0.5 * {SMALL} as do_remove,
  {t('do_mask_points')} < 0.5 * {SMALL} as do_mask, {t('do_remove_slice')} < 0.5 * {SMALL} as do_slice,
  [90, 180, 270][cast(floor({t('angle')} * 3) as int) + 1] as angle, ['x', 'y', 'both'][cast(floor({t('axis')} * 3) as int) + 1] as axis
  from (select tile_id, count(*) as n from src group by 1)),
turned as (select src.* exclude (x, y), flags.* exclude (tile_id),
  case when not do_rotate then x when angle = 90 then y when angle = 180 then -x else -y end as x,
  case when not do_rotate then y when angle = 90 then -x when angle = 180 then -y else x end as y from src join flags using (tile_id)),
mirrored as (select * exclude (x, y), case when do_reflect and axis in ('x', 'both') then -x else x end as x,
  case when do_reflect and axis in ('y', 'both') then -y else y end as y from turned),
moved as (select tile_id, pid, x + case when do_jitter then {norm('jitter_x')} * 0.02 else 0.0 end as x, y + case when do_jitter then {norm('jitter_y')} * 0.02 else 0.0 end as y,
  z + case when do_jitter then {norm('jitter_z')} * 0.01 else 0.0 end as z,
  case when do_attributes then least(greatest(intensity * (0.9 + (1.1 - 0.9) * {t('scale_intensity')}) + (-0.1 + (0.1 + 0.1) * {t('shift_intensity')}), -1), 1) else intensity end as intensity,
  case when do_attributes then least(greatest(return_number, -1), 1) else return_number end as return_number from mirrored),
{step_sql('added', 'moved', 'do_add', f'''add_g as (select *, {norm('add_x')} as gx, {norm('add_y')} as gy, {norm('add_z')} as gz, {p('add_d')} * 0.02 as st
  from ({ranked('added_in', 'add')}) where rn <= cast(trunc(n * 0.1) as bigint)),
add_l as (select *, sqrt(pow(gx, 2) + pow(gy, 2) + pow(gz, 2)) + 1e-8 as len from add_g),
add_out as (select {KEEP} from added_in union all select tile_id, -1 - pid, x + gx / len * st, y + gy / len * st, z + gz / len * st, intensity, return_number from add_l)''', 'add_out')},
{step_sql('removed', 'added', 'do_remove', f'''remove_out as (select {KEEP} from ({ranked('removed_in', 'remove')}) where rn <= greatest(least(cast(trunc(n * 0.9::double) as bigint), n), least(100, n)))''', 'remove_out')},
{step_sql('masked', 'removed', 'do_mask', f'''mask_c as (select tile_id, x as cx, y as cy from masked_in qualify row_number() over (partition by tile_id order by {p('mask0_centre')}, x, y, z, pid) = 1),
mask_hit as (select m.*, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) < 0.05 + (0.2 - 0.05) * {t('mask0_radius')} as hit from masked_in m join mask_c using (tile_id)),
mask_hole as (select {KEEP} from mask_hit where hit),
mask_kept as (select {KEEP} from mask_hit where not hit union all {thinned('mask0', 'mask_hole')}),
{floored('mask_out', 'masked_in', 'mask_kept', 'mask')}''', 'mask_out')},
{step_sql('sliced', 'masked', 'do_slice', f'''slice_b as (select tile_id, reach, hi, least(0.05, hi) as lo from (select tile_id, max(z) * 0.5 as reach, least(0.2, max(z) * 0.5) as hi from sliced_in group by 1)),
slice_h as (select tile_id, reach, lo + (hi - lo) * {t('slice_h')} as h from slice_b),
slice_z as (select tile_id, h, greatest(reach - h, 0) * {t('slice_z')} as bottom from slice_h),
slice_hit as (select s.*, z >= bottom and z <= bottom + h as hit from sliced_in s join slice_z using (tile_id)),
slice_part as (select {KEEP} from slice_hit where hit),
slice_kept as (select {KEEP} from slice_hit where not hit union all {thinned('slice', 'slice_part')}),
{floored('slice_out', 'sliced_in', 'slice_kept', 'slice')}''', 'slice_out')},
verdict as (select s.tile_id, coalesce(n, 0) < {LEAST} as failed from (select distinct tile_id from src) s left join (select tile_id, count(*) as n from sliced group by 1) using (tile_id)),
going as (select {KEEP} from sliced join verdict using (tile_id) where not failed union all select {KEEP} from src join verdict using (tile_id) where failed)"""


def _dep(spark, d):
    return b.points(spark, d).where("cloud = 'dep'").select(*COLS)


def few(least: int):
    return lambda points: augmentation_violations(points.withColumn("cloud", F.lit("dep")), None, "dep", least, 300.0, ("x",))


def _kept(spark, d) -> redraw.Kept:
    dep = _dep(spark, d)
    return redraw.augment_or_keep(dep, "42", a.step_draws(dep, "42"), few(LEAST), ATTRIBUTES)


@query("augment_sequence", f"with {POINTS}, {SEQUENCE} select tile_id, pid, {rr('x', 'y', 'z', *ATTRIBUTES)} from sliced")
def augment_sequence(spark, d):
    dep = _dep(spark, d)
    return a.augment_points(dep, "42", a.step_draws(dep, "42"), ATTRIBUTES)


@query("augment_or_keep", f"with {POINTS}, {SEQUENCE} select tile_id, pid, {rr('x', 'y', 'z', *ATTRIBUTES)} from going")
def augment_or_keep(spark, d):
    return _kept(spark, d).points


@query("augment_outcome", f"""with {POINTS}, {SEQUENCE}
select tile_id, not failed as augmented, case when failed then ['too_few_points'] else [] end as violations from verdict""")
def augment_outcome(spark, d):
    return _kept(spark, d).outcome.select("tile_id", "augmented", "violations")


@query("augment_kept_graph", f"""with {POINTS.replace('points as', 'every as', 1)},
{SEQUENCE.replace('from points where', 'from every where', 1)},
points as (select *, 'dep' as cloud from going), {_knn(4)}
select tile_id, 4 as k, pid as src, n_pid as dst from knn union select tile_id, 4, n_pid, pid from knn""")
def augment_kept_graph(spark, d):
    return redraw.regraph(_kept(spark, d), edge_table(_dep(spark, d), 4), 4)


@query("augment_sequence_graph", f"""with {POINTS.replace('points as', 'every as', 1)},
{SEQUENCE.replace('from points where', 'from every where', 1)},
points as (select *, 'dep' as cloud from sliced), {_knn(4)}
select tile_id, 4 as k, pid as src, n_pid as dst from knn union select tile_id, 4, n_pid, pid from knn""")
def augment_sequence_graph(spark, d):
    return edge_table(augment_sequence(spark, d), 4)


# --- copies drawn again --------------------------------------------------------

WANTED, CAP, ATTEMPTS, ROUNDS, MOST_LEFT = 140, 4, 6, 8, 455


def _share(at: int) -> str:
    """One round: shares within the rooms, numbers by systematic draws, verdicts from the table ``ok``."""
    seed = f"'42_{at}'"
    return f"""o{at} as (select tile_id, p, tried, least({ATTEMPTS} - tried, {CAP} - accepted) as room from s{at} where p > 0 and tried < {ATTEMPTS} and accepted < {CAP}),
l{at} as (select {WANTED} - sum(accepted) as miss, case when sum(tried) = 0 then {WANTED}
  else least(8 * miss, (miss * sum(tried) + greatest(1, sum(passed)) - 1) // greatest(1, sum(passed))) end as want from s{at}),
w{at} as (select tile_id, p, room, want, row_number() over w - 1 as k, sum(p) over () as sp, sum(room) over () as sr,
  coalesce(sum(p) over (w rows between unbounded preceding and 1 preceding), 0) as pa, coalesce(sum(room) over (w rows between unbounded preceding and 1 preceding), 0) as ra
  from o{at}, l{at} where miss > 0 window w as (order by p / room desc, tile_id)),
f{at} as (select min_by((want - ra) / (sp - pa), k) as f from w{at} where p * (want - ra) / (sp - pa) < room),
e{at} as (select tile_id, case when sr <= want then room::double else least(p * f, room::double) end as e, {draw(seed, 'tile_id')} as u from w{at}, f{at}),
c{at} as (select *, sum(e) over (order by u, tile_id) as upto from e{at}),
n{at} as (select tile_id, cast(floor(round(upto, 9) + {draw(seed, "'start'")}) - floor(round(upto - e, 9) + {draw(seed, "'start'")}) as int) as n from c{at}),
g{at} as (select o.tile_id, tried + i as attempt from o{at} o join n{at} n using (tile_id), (select unnest(range({ATTEMPTS})) as i) where i < n),
h{at} as (select tile_id, attempt, ok, ok and row_number() over (order by not ok, {draw(seed, "'keep'", "tile_id || '_aug_' || cast(attempt as varchar)")}, tile_id || '_aug_' || cast(attempt as varchar)) <= miss as taken
  from g{at} join ok using (tile_id, attempt), l{at}),
a{at} as (select tile_id, count(*) as t, count(*) filter (where ok) as k, count(*) filter (where taken) as a from h{at} group by 1),
s{at + 1} as (select s.tile_id, p, accepted + coalesce(a, 0) as accepted, passed + coalesce(k, 0) as passed, tried + coalesce(t, 0) as tried from s{at} s left join a{at} using (tile_id))"""


# Every possible copy is judged once; the rounds then only look the verdicts up.
_COPIES = f"""wq as (select tile_id, count(*)::double as p from points group by 1),
cp as (select tile_id as of, cast(i as bigint) as attempt, tile_id || '_aug_' || cast(i as varchar) as tile_id, pid, x, y, z from points, (select unnest(range({ATTEMPTS})) as i) where cloud = 'uav'),
cc as (select tile_id, x as cx, y as cy from cp qualify row_number() over (partition by tile_id order by {p('mask0_centre')}, x, y, z, pid) = 1),
hit as (select cp.*, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) < 1.0 + (5.0 - 1.0) * {t('mask0_radius')} as hit from cp join cc using (tile_id)),
cn as (select of, attempt, tile_id, count(*) as n, count(*) filter (where hit) as h from hit group by all),
left_ as (select of, attempt, n, n - cast(trunc(h * (0.7 + (1.0 - 0.7) * {t('mask0_share')})) as bigint) as kept from cn),
ok as (select of as tile_id, attempt, case when kept < least(100, n) then least(100, n) else kept end >= {MOST_LEFT} as ok from left_),
s0 as (select tile_id, p, 0 as accepted, 0 as passed, 0 as tried from wq),
{", ".join(_share(i) for i in range(ROUNDS))}"""


def _redrawn(spark, d) -> redraw.Redrawn:
    pts = b.points(spark, d)
    uav = pts.where("cloud = 'uav'").select("tile_id", "pid", "x", "y", "z")
    weights = pts.groupBy("tile_id").agg(F.count(F.lit(1)).cast("double").alias("p"))
    return redraw.redrawn_copies(
        weights, WANTED, "42", lambda ids: a.mask_points(a.expand(uav, ids), "42", 1.0, 5.0), few(MOST_LEFT), CAP, ATTEMPTS
    )


@query("redrawn_copies", f"""with {POINTS}, {_COPIES}
{" union all ".join(f"select tile_id, attempt, tile_id || '_aug_' || cast(attempt as varchar) as new_id, {i} as round from h{i} where taken" for i in range(ROUNDS))}""")
def redrawn_copies(spark, d):
    return _redrawn(spark, d).copies


@query("redraw_report", f"""with {POINTS}, {_COPIES}
select tile_id, accepted, passed - accepted as spare, tried - passed as rejected, case when accepted >= {CAP} then 'full' when tried >= {ATTEMPTS} then 'exhausted' else 'open' end as status from s{ROUNDS}""")
def redraw_report(spark, d):
    return _redrawn(spark, d).report
