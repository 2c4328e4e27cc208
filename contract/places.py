"""S, J1-J5, J9, T and X families: catalogs, boxes, polygons and tiling."""

from pyspark.sql import functions as F

from contract.base import (
    ITEMS, PIXELS, POINTS, POLYS, TILES, WORLD_POINTS, draw, query, r, rr,
)
from tileloom import bindings as b
from tileloom.functions import geo, names, values as v
from tileloom.operators import cover as cv, quality as q, spatial as sp
from tileloom.sources import catalog as cat, tiles as tl

_ITEM_BOX = ("minx", "miny", "maxx", "maxy")


@query("catalog_items", f"""with {ITEMS}
select item_id, collection, dt, {rr('minx', 'miny', 'maxx', 'maxy')},
  {r('case when orderkey % 2 = 0 then orderkey % 13 end', 'minz')},
  {r('case when orderkey % 2 = 0 then orderkey % 13 + 20.5 end', 'maxz')},
  's3://scenes/' || item_id || '.laz' as href from items""")
def catalog_items(spark, d):
    # Features as they lie in item files, with 4- and 6-number boxes, read back from JSON text.
    it = b.items(spark, d)
    z = F.col("orderkey") % 13
    flat = F.array("minx", "miny", "maxx", "maxy")
    deep = F.array(F.col("minx"), F.col("miny"), z.cast("double"), F.col("maxx"), F.col("maxy"), z + F.lit(20.5))
    feature = it.select(F.to_json(F.struct(
        F.col("item_id").alias("id"), "collection",
        F.when(F.col("orderkey") % 2 == 0, deep).otherwise(flat).alias("bbox"),
        F.create_map(F.lit("datetime"), F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss")).alias("properties"),
        F.create_map(F.lit("data"), F.struct(F.concat(F.lit("s3://scenes/"), "item_id", F.lit(".laz")).alias("href"))).alias("assets"),
    )).alias("text"))
    from tileloom.schemas import ITEM_FILE

    raw = feature.select(F.from_json("text", ITEM_FILE).alias("f")).select("f.*")
    out = cat.items_from_features(raw)
    return out.select(
        "item_id", "collection", F.col("dt"), *_ITEM_BOX, "minz", "maxz", F.col("assets")["data"].alias("href")
    )


@query("geojson_tiles", f"""with {TILES}
select case when s.s_suppkey % 2 = 0 then 'given_' || cast(s.s_suppkey as varchar) else cast(s.s_suppkey % 50 as varchar) end as tile_id,
  'tile_' || cast(s.s_suppkey % 50 as varchar) as position_id, {rr('xmin', 'ymin', 'xmax', 'ymax')}
from tiles t join supplier s on t.tile_id = 'tile_' || cast(s.s_suppkey as varchar)""")
def geojson_tiles(spark, d):
    from tileloom.schemas import TILE_FILE

    key = F.regexp_extract("tile_id", r"(\d+)", 1).cast("long")

    def feature(t):
        ring = F.array(
            F.array(t["xmin"], t["ymin"]), F.array(t["xmax"], t["ymin"]), F.array(t["xmax"], t["ymax"]),
            F.array(t["xmin"], t["ymax"]), F.array(t["xmin"], t["ymin"]),
        )
        given = F.concat(F.lit("given_"), t["k"].cast("string"))
        return F.struct(
            F.when(t["k"] % 2 == 0, F.create_map(F.lit("tile_id"), given)).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        )

    # A tile file is one JSON text; fifty tiles in each.
    boxes = F.array_sort(F.collect_list(F.struct(key.alias("k"), *sp.BOX)))
    text = b.tiles(spark, d).groupBy(F.floor(key / 50).alias("file")).agg(boxes.alias("boxes")).select(
        F.to_json(F.struct(F.transform("boxes", feature).alias("features"))).alias("text")
    )
    raw = text.select(F.from_json("text", TILE_FILE).alias("t")).select("t.*")
    return tl.tiles_from_features(raw).drop("source")


@query("tile_geometry_attached", f"""with {TILES}
select 'tile_' || cast(p_partkey as varchar) as tile_id, {rr('xmin', 'ymin', 'xmax', 'ymax')}
from part left join tiles t on t.tile_id = 'tile_' || cast(p_partkey as varchar)""")
def tile_geometry_attached(spark, d):
    shapes = b.tiles(spark, d).withColumnRenamed("tile_id", "position_id")
    rows = b.evaluation(spark, d).select("tile_id")
    return tl.attach_geometry(rows, shapes)


@query("combined_chunks", """with rows as (select 'chunk_' || cast(l_orderkey % 7 as varchar) || '.parquet' as source_file,
  'tile_' || cast(l_suppkey as varchar) as tile_id, l_quantity, l_extendedprice from lineitem),
f as (select *, dense_rank() over (order by source_file) as fr from rows),
t as (select *, dense_rank() over (partition by source_file order by tile_id) as tr from f where fr <= 4)
select source_file, tile_id, count(*) as n, round(sum(cast(cast(l_extendedprice as float) as double)), 2) + 0.0 as total
from t where tr <= 25 group by 1, 2""")
def combined_chunks(spark, d):
    rows = b.table(spark, d, "lineitem").selectExpr(
        "concat('chunk_', cast(l_orderkey % 7 as string), '.parquet') as source_file",
        "concat('tile_', cast(l_suppkey as string)) as tile_id", "l_quantity", "l_extendedprice",
    )
    kept = tl.combine_chunks(rows, 4, 25, True)
    return kept.groupBy("source_file", "tile_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("total")
    )


_NAMES = """n as (select p_partkey, case when p_partkey % 5 = 0 then 'x' else '' end || 'area_' || cast(p_partkey as varchar) || '_L090_scene_'
    || case when p_partkey % 7 = 0 then 'nodate' else lpad(cast(10 + p_partkey % 12 as varchar), 2, '0') || lpad(cast(1 + p_partkey % 12 as varchar), 2, '0') || lpad(cast(1 + p_partkey % 28 as varchar), 2, '0') end
    || '_' || case when p_partkey % 3 = 0 then 'HHHH' else 'HVHV' end || '_20' || lpad(cast(10 + p_partkey % 12 as varchar), 2, '0') || '0229_classified.las' as name,
  case when p_partkey % 2 = 0 then 'EPSG:' || cast(32600 + p_partkey % 60 as varchar) else 'local' end as crs from part)"""


def _names(spark, d):
    return b.table(spark, d, "part").selectExpr(
        "p_partkey",
        "concat(case when p_partkey % 5 = 0 then 'x' else '' end, 'area_', cast(p_partkey as string), '_L090_scene_', "
        "case when p_partkey % 7 = 0 then 'nodate' else concat(lpad(cast(10 + p_partkey % 12 as string), 2, '0'), "
        "lpad(cast(1 + p_partkey % 12 as string), 2, '0'), lpad(cast(1 + p_partkey % 28 as string), 2, '0')) end, "
        "'_', case when p_partkey % 3 = 0 then 'HHHH' else 'HVHV' end, '_20', "
        "lpad(cast(10 + p_partkey % 12 as string), 2, '0'), '0229_classified.las') as name",
        "case when p_partkey % 2 = 0 then concat('EPSG:', cast(32600 + p_partkey % 60 as string)) else 'local' end as crs",
    )


@query("name_metadata", f"""with {_NAMES}
select p_partkey, try_cast(try_strptime(nullif(regexp_extract(name, '(\\d{{8}})', 1), ''), '%Y%m%d') as date) as day8,
  cast(try_strptime(case when regexp_matches(split_part(name, '_', 5), '^\\d{{6}}$') then '20' || split_part(name, '_', 5) end, '%Y%m%d') as date) as day6,
  try_cast(nullif(regexp_extract(crs, '^EPSG:(\\d+)$', 1), '') as int) as epsg,
  split_part(name, '_classified', 1) as stem,
  regexp_matches(name, '^area_') as is_area, not regexp_matches(lower(name), 'hhhh') as kept
from n""")
def name_metadata(spark, d):
    name = F.col("name")
    return _names(spark, d).select(
        "p_partkey", names.date8(name).alias("day8"), names.date6_token(name).alias("day6"),
        names.epsg(F.col("crs")).alias("epsg"), names.before_classified(name).alias("stem"),
        names.matches(name, "^area_").alias("is_area"), names.not_excluded(name, ["hhhh"]).alias("kept"),
    )


@query("items_not_ingested", f"""with {ITEMS}
select item_id, {r('minx')} from items where status <> 'F'""")
def items_not_ingested(spark, d):
    it = b.items(spark, d)
    return cat.not_yet(it, it.where("status = 'F'")).select("item_id", "minx")


@query("collection_extent", f"""with {ITEMS}
select collection, {r('min(minx)', 'minx')}, {r('min(miny)', 'miny')}, {r('max(maxx)', 'maxx')}, {r('max(maxy)', 'maxy')},
  min(dt) as start, max(dt) as "end", count(*) as n_items from items group by 1
union all select 'NONE', -180.0, -90.0, 180.0, 90.0, null, null, 0""")
def collection_extent(spark, d):
    it = b.items(spark, d)
    known = it.select("collection").distinct()
    empty = known.limit(1).select(F.lit("NONE").alias("collection"))
    return cat.extent_or_default(known.unionByName(empty), it)


@query("collection_extent_3d", f"""with {ITEMS}
select collection, {r('min(minx)', 'minx')}, {r('min(miny)', 'miny')}, {r('max(maxx)', 'maxx')}, {r('max(maxy)', 'maxy')},
  min(dt) as start, max(dt) as "end", count(*) as n_items, {r('min(price / 1000)', 'minz')}, {r('max(price / 500)', 'maxz')}
from items group by 1""")
def collection_extent_3d(spark, d):
    it = b.items(spark, d).withColumn("minz", F.col("price") / 1000).withColumn("maxz", F.col("price") / 500)
    return cat.extent_3d(it)


@query("dataset_summary", f"""with {POINTS}, {PIXELS},
c as (select tile_id, count(*) filter (where cloud = 'dep') as n_dep, count(*) filter (where cloud = 'uav') as n_uav from points group by 1),
i as (select tile_id, count(distinct image_id) filter (where sensor = 'naip') as n_naip,
  count(distinct image_id) filter (where sensor = 'uavsar') as n_uavsar from pixels group by 1)
select tile_id, n_dep, n_uav, coalesce(n_naip, 0) as n_naip, coalesce(n_uavsar, 0) as n_uavsar,
  coalesce(n_naip, 0) > 0 as has_naip, coalesce(n_uavsar, 0) > 0 as has_uavsar from c left join i using (tile_id)""")
def dataset_summary(spark, d):
    return tl.dataset_summary(b.points(spark, d), b.pixels(spark, d))


_LEDGER = """c as (select tile_id, count(*) filter (where cloud = 'uav') as u, count(*) filter (where cloud = 'dep') as e from points group by 1),
log as (select tile_id, case when u < 500 then 'few UAV points' when e < 80 then 'no DEP points' end as reason from c)"""


def _log(spark, d):
    p = b.points(spark, d)
    counts = q.counts_by_cloud(p)
    reason = F.when(F.col("n_uav") < 500, "few UAV points").when(F.col("n_dep") < 80, "no DEP points")
    failed = counts.select("tile_id", reason.alias("reason")).where("reason is not null")
    return tl.ledger(counts, failed)


@query("run_ledger", f"""with {POINTS}, {_LEDGER}
select case when reason is null then 'succeeded' else 'failed' end as status, reason, count(*) as n_tiles from log group by 1, 2""")
def run_ledger(spark, d):
    return tl.run_summary(_log(spark, d))


@query("tiles_to_rerun", f"""with {POINTS}, {_LEDGER} select tile_id from log where reason is not null""")
def tiles_to_rerun(spark, d):
    return tl.to_rerun(tl.tile_ids(b.points(spark, d)), _log(spark, d))


@query("dataset_bytes", f"""with {PIXELS},
p as (select sensor as source_file, image_id, band, count(*) as n from pixels group by 1, 2, 3)
select source_file, count(*) as n_rows, cast(sum(n) * 4 as bigint) as n_bytes from p group by 1""")
def dataset_bytes(spark, d):
    packed = tl.pack_images(b.pixels(spark, d).withColumnRenamed("sensor", "source_file"), ["source_file", "image_id", "band"])
    return tl.size_in_bytes(packed, "data")


@query("catalog_from_listing", f"""with {_NAMES},
l as (select name, regexp_extract(name, '^(area_\\d+)_L090_scene_[0-9a-z]+_([HV]+)', 1) as item_id,
  regexp_extract(name, '^(area_\\d+)_L090_scene_[0-9a-z]+_([HV]+)', 2) as asset,
  p_partkey % 100 as x, p_partkey % 37 as y from n where regexp_matches(name, '^(area_\\d+)_L090_scene_[0-9a-z]+_([HV]+)'))
select item_id, min(asset) as asset_names, count(distinct asset) as n_assets, {r('min(x)', 'minx')}, {r('max(y + 1)', 'maxy')} from l
where not regexp_matches(name, 'nodate') group by 1""")
def catalog_from_listing(spark, d):
    listing = _names(spark, d).select(
        F.concat(F.lit("s3://bucket/in/"), "name").alias("path"),
        (F.col("p_partkey") % 100).cast("double").alias("minx"), (F.col("p_partkey") % 37).cast("double").alias("miny"),
        (F.col("p_partkey") % 100 + 1).cast("double").alias("maxx"), (F.col("p_partkey") % 37 + 1).cast("double").alias("maxy"),
    )
    built = cat.build_items(
        listing, r"^(area_\d+)_L090_scene_[0-9a-z]+_([HV]+)", F.lit(None).cast("date"), exclude=["NODATE"]
    )
    return built.select(
        "item_id", F.array_join(F.map_keys("assets"), ",").alias("asset_names"), "n_assets", "minx", "maxy"
    )


@query("one_tile", f"""with {POINTS} select pid, {rr('x', 'y', 'z')} from points where tile_id = 'tile_3'""")
def one_tile(spark, d):
    return tl.one_tile(b.points(spark, d), "tile_3").select("pid", "x", "y", "z")


@query("tile_at_position", f"""with {POINTS}, k as (select tile_id from points group by 1 order by 1 limit 1 offset 5)
select tile_id, count(*) as n from points join k using (tile_id) group by 1""")
def tile_at_position(spark, d):
    return tl.tile_at(b.points(spark, d), 5).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))


@query("tile_ids", f"""with {POINTS} select distinct tile_id from points""")
def tile_ids(spark, d):
    return tl.tile_ids(b.points(spark, d))


@query("items_in_any_box", f"""with {ITEMS}, {POLYS},
h as (select poly_id, min(least(x1, x2)) as xmin, min(least(y1, y2)) as ymin, max(greatest(x1, x2)) as xmax, max(greatest(y1, y2)) as ymax from polys group by 1)
select item_id from items i where exists (select 1 from h where minx <= xmax and maxx >= xmin and miny <= ymax and maxy >= ymin)""")
def items_in_any_box(spark, d):
    areas = b.polygons(spark, d).groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"), F.max(F.greatest("y1", "y2")).alias("ymax"),
    )
    return sp.any_box(b.items(spark, d), areas, 20.0, _ITEM_BOX, sp.BOX).select("item_id")


@query("items_in_dates", f"""with {ITEMS} select item_id, dt from items where cast(dt as date) between date '1996-03-01' and date '1997-02-28'""")
def items_in_dates(spark, d):
    return b.items(spark, d).where(cat.in_dates(F.col("dt"), "1996-03-01", "1997-02-28")).select("item_id", "dt")


@query("items_on_tiles", f"""with {ITEMS}, {TILES}
select tile_id, count(*) as n_items, min(dt) as first_dt, max(item_id) as last_item from items join tiles
on minx <= xmax and maxx >= xmin and miny <= ymax and maxy >= ymin
where cast(dt as date) between date '1996-03-01' and date '1998-02-28' group by 1""")
def items_on_tiles(spark, d):
    found = cat.items_on_tiles(b.items(spark, d), b.tiles(spark, d), 20.0, "1996-03-01", "1998-02-28")
    return found.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("dt").alias("first_dt"), F.max("item_id").alias("last_item")
    )


@query("points_to_tiles", f"""with {WORLD_POINTS}, {TILES}
select tile_id, cloud, count(*) as n, {r('sum(z)', 'sz', 3)} from world join tiles
on x between xmin and xmax and y between ymin and ymax group by 1, 2""")
def points_to_tiles(spark, d):
    found = sp.points_to_tiles(b.world_points(spark, d), b.tiles(spark, d), 11.5)
    return found.groupBy("tile_id", "cloud").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 3).alias("sz")
    )


_SIDES = """(x2 - x1) * (ymin - y1) - (y2 - y1) * (xmin - x1) as s1, (x2 - x1) * (ymax - y1) - (y2 - y1) * (xmin - x1) as s2,
 (x2 - x1) * (ymin - y1) - (y2 - y1) * (xmax - x1) as s3, (x2 - x1) * (ymax - y1) - (y2 - y1) * (xmax - x1) as s4"""


def _poly_sql(closed: bool, tiles: str = "tiles") -> str:
    le, lt = ("<=", ">=") if closed else ("<", ">")
    px, py = ("xmin", "ymin") if closed else ("(xmin + xmax) / 2", "(ymin + ymax) / 2")
    verdict = "rays % 2 = 1 or edge" if closed else "rays % 2 = 1 and not edge"
    return f"""e as (select t.tile_id, p.poly_id,
   (((y1 <= {py} and {py} < y2) or (y2 <= {py} and {py} < y1)) and x1 + ({py} - y1) * (x2 - x1) / nullif(y2 - y1, 0) > {px}) as ray,
   greatest(x1, x2) {lt} xmin and least(x1, x2) {le} xmax and greatest(y1, y2) {lt} ymin and least(y1, y2) {le} ymax as near, {_SIDES}
  from {tiles} t, polys p),
v as (select tile_id, poly_id, count(*) filter (where ray) as rays,
  bool_or(near and least(s1, s2, s3, s4) {le} 0 and greatest(s1, s2, s3, s4) {lt} 0) as edge from e group by 1, 2),
hit as (select tile_id, poly_id from v where {verdict})"""


@query("tiles_meeting_polygons", f"""with {TILES}, {POLYS}, {_poly_sql(True)} select * from hit""")
def tiles_meeting_polygons(spark, d):
    return sp.tiles_on_polygons(b.tiles(spark, d), b.polygons(spark, d), 12.0)


_SMALL = """small as (select p_partkey, 'tile_' || cast(p_partkey as varchar) as tile_id,
  ((p_partkey * 7919) % 1000) / 10.0::double as xmin, ((p_partkey * 104729) % 1000) / 10.0::double as ymin,
  ((p_partkey * 7919) % 1000) / 10.0::double + 1.7::double as xmax, ((p_partkey * 104729) % 1000) / 10.0::double + 1.3::double as ymax from part)"""


@query("tiles_inside_polygons", f"""with {_SMALL}, {POLYS}, {_poly_sql(False, 'small')} select * from hit""")
def tiles_inside_polygons(spark, d):
    small = b.table(spark, d, "part").selectExpr(
        "concat('tile_', cast(p_partkey as string)) as tile_id",
        "((p_partkey * 7919) % 1000) / 10.0D as xmin", "((p_partkey * 104729) % 1000) / 10.0D as ymin",
        "((p_partkey * 7919) % 1000) / 10.0D + 1.7D as xmax", "((p_partkey * 104729) % 1000) / 10.0D + 1.3D as ymax",
    )
    return sp.tiles_on_polygons(small, b.polygons(spark, d), 4.0, "contained")


@query("points_in_polygons", f"""with {WORLD_POINTS}, {POLYS},
c as (select w.pid, w.cloud, w.x, w.y, p.poly_id from world w, polys p
  where ((y1 <= w.y and w.y < y2) or (y2 <= w.y and w.y < y1)) and x1 + (w.y - y1) * (x2 - x1) / nullif(y2 - y1, 0) > w.x
  group by 1, 2, 3, 4, 5 having count(*) % 2 = 1)
select cloud, count(distinct (pid, x, y)) as n from c group by 1""")
def points_in_polygons(spark, d):
    inside = cv.points_in_polygons(b.world_points(spark, d), b.polygons(spark, d), 0.5)
    return inside.groupBy("cloud").agg(F.count_distinct("pid", "x", "y").alias("n"))


_RAY = "((y1 <= {y} and {y} < y2) or (y2 <= {y} and {y} < y1)) and x1 + ({y} - y1) * (x2 - x1) / nullif(y2 - y1, 0) > {x}"
#: Polygons of many corners around the same places: a ring of 24 corners, and a hole of half its size.
STARS = """stars_c as (select 'star_' || cast(n_nationkey as varchar) as poly_id, ((n_nationkey * 37) % 100) + 3.25::double as px, ((n_nationkey * 53) % 100) + 2.75::double as py,
    9.5::double + (n_nationkey % 7) * 3.5::double as pr from nation),
turn as (select i, s from (select unnest(range(24)) as i), (select unnest([1.0::double, 0.5::double]) as s)),
corner as (select poly_id, i, s, px + pr * s * (case when i % 2 = 0 then 1.0::double else 0.55::double end) * ((i * 7 + 3) % 24 - 11.5::double) / 12 as x,
  py + pr * s * (case when i % 2 = 0 then 1.0::double else 0.55::double end) * ((i * 11 + 5) % 24 - 11.5::double) / 12 as y from stars_c, turn),
stars as (select a.poly_id, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from corner a join corner b on a.poly_id = b.poly_id and a.s = b.s and b.i = (a.i + 1) % 24)"""


def _stars(spark, d):
    """Self-crossing rings, which parity handles as well."""
    base = b.table(spark, d, "nation").selectExpr(
        "concat('star_', cast(n_nationkey as string)) as poly_id", "((n_nationkey * 37) % 100) + 3.25D as px",
        "((n_nationkey * 53) % 100) + 2.75D as py", "9.5D + (n_nationkey % 7) * 3.5D as pr",
    )
    corners = base.selectExpr("*", "explode(array(1.0D, 0.5D)) as s").selectExpr("*", "explode(sequence(0, 23)) as i").selectExpr(
        "poly_id", "i", "s",
        "px + pr * s * (case when i % 2 = 0 then 1.0D else 0.55D end) * ((i * 7 + 3) % 24 - 11.5D) / 12 as x",
        "py + pr * s * (case when i % 2 = 0 then 1.0D else 0.55D end) * ((i * 11 + 5) % 24 - 11.5D) / 12 as y",
    )
    after = corners.selectExpr("poly_id", "s", "(i + 23) % 24 as i", "x as x2", "y as y2")
    return corners.selectExpr("poly_id", "s", "i", "x as x1", "y as y1").join(after, ["poly_id", "s", "i"]).select("poly_id", "x1", "y1", "x2", "y2")


@query("points_in_areas", f"""with {WORLD_POINTS}, {STARS}
select pid, cloud, {rr('x', 'y')}, area_id from (select w.pid, w.cloud, w.x, w.y, p.poly_id as area_id from (select distinct pid, cloud, x, y from world) w, stars p where {_RAY.format(x='w.x', y='w.y')}
  group by all having count(*) % 2 = 1)""")
def points_in_areas(spark, d):
    world = b.world_points(spark, d).select("pid", "cloud", "x", "y").distinct()
    return cv.points_in_areas(world, _stars(spark, d), 0.5, 4)


@query("pixels_in_areas", f"""with {PIXELS}, {STARS},
u as (select *, 10.0::double * (user_id % 10) + (col + 0.5) * 2.5 as x, 10.0::double * (user_id // 10 % 10) + 10 - (row + 0.5) * 2.5 as y from pixels)
select event_id, area_id from (select u.event_id, p.poly_id as area_id from u, stars p where {_RAY.format(x='u.x', y='u.y')} group by all having count(*) % 2 = 1)""")
def pixels_in_areas(spark, d):
    px = b.pixels(spark, d)
    boxes = px.selectExpr("tile_id", "10.0D * (user_id % 10) as xmin", "10.0D * (user_id div 10 % 10) + 10 as ymax").distinct()
    return cv.pixels_in_areas(px, boxes, _stars(spark, d), 2.5, 0.5).select("event_id", "area_id")


@query("points_in_area", f"""with {WORLD_POINTS} select cloud, count(*) as n, {r('max(z)', 'top')} from world
where x between 12.5 and 47 and y between 3 and 66.25 group by 1""")
def points_in_area(spark, d):
    from tileloom.operators.grid import fixed_box

    kept = b.world_points(spark, d).where(sp.in_box(F.col("x"), F.col("y"), fixed_box(12.5, 3, 47, 66.25)))
    return kept.groupBy("cloud").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("top"))


@query("tiling_of_boxes", """with a as (select cast(c_custkey as varchar) as area_id, cast(c_custkey % 50 as double) as x0, cast(c_custkey % 31 as double) as y0,
  cast(c_custkey % 50 + 8 + c_custkey % 40 as double) as x1, cast(c_custkey % 31 + 12 + c_custkey % 23 as double) as y1 from customer),
i as (select unnest(range(60)) as i)
select area_id, a1.i as ix, a2.i as iy, round(x0 + a1.i * 8.5, 6) + 0.0 as xmin, round(y0 + a2.i * 8.5, 6) + 0.0 as ymin,
  round(x0 + a1.i * 8.5 + 10, 6) + 0.0 as xmax, round(y0 + a2.i * 8.5 + 10, 6) + 0.0 as ymax
from a, i a1, i a2 where x0 + a1.i * 8.5 + 10 <= x1 + 1e-9 and y0 + a2.i * 8.5 + 10 <= y1 + 1e-9""")
def tiling_of_boxes(spark, d):
    area = b.table(spark, d, "customer").selectExpr(
        "cast(c_custkey as string) as area_id", "cast(c_custkey % 50 as double) as xmin", "cast(c_custkey % 31 as double) as ymin",
        "cast(c_custkey % 50 + 8 + c_custkey % 40 as double) as xmax", "cast(c_custkey % 31 + 12 + c_custkey % 23 as double) as ymax",
    )
    return sp.tile_boxes(area, 10.0, 10.0, 0.15)


@query("tiling_of_polygons", f"""with {POLYS},
h as (select poly_id, min(least(x1, x2)) as x0, min(least(y1, y2)) as y0, max(greatest(x1, x2)) as xe, max(greatest(y1, y2)) as ye from polys group by 1),
i as (select unnest(range(60)) as i),
tt as (select poly_id as own, poly_id || '_' || cast(a1.i as varchar) || '_' || cast(a2.i as varchar) as tile_id, x0 + a1.i * 2.55 as xmin, y0 + a2.i * 2.55 as ymin,
  x0 + a1.i * 2.55 + 3 as xmax, y0 + a2.i * 2.55 + 3 as ymax from h, i a1, i a2
  where x0 + a1.i * 2.55 + 3 <= xe + 1e-9 and y0 + a2.i * 2.55 + 3 <= ye + 1e-9),
{_poly_sql(False, 'tt')}
select tt.tile_id, {rr('xmin', 'ymin', 'xmax', 'ymax')} from hit join tt on hit.tile_id = tt.tile_id and hit.poly_id = tt.own""")
def tiling_of_polygons(spark, d):
    return sp.tiles_over_polygons(b.polygons(spark, d), 3.0).select("tile_id", *sp.BOX)


@query("latest_item_per_tile", f"""with {ITEMS},
n as (select collection || '/' || cast(orderkey % 50 as varchar) as tile_id, case when orderkey % 17 = 0 then null else dt end as dt, item_id, minx from items),
k as (select *, row_number() over (partition by tile_id order by coalesce(dt, timestamp '0001-01-01') desc, item_id desc) as rn from n)
select tile_id, dt, item_id, {r('minx')} from k where rn = 1""")
def latest_item_per_tile(spark, d):
    rows = b.items(spark, d).select(
        F.concat("collection", F.lit("/"), (F.col("orderkey") % 50).cast("string")).alias("tile_id"),
        F.when(F.col("orderkey") % 17 != 0, F.col("dt")).alias("dt"), "item_id", "minx",
    )
    return q.latest_per_key(rows, ["tile_id"], F.col("dt"), ["item_id"])


@query("time_ordered_items", f"""with {ITEMS}
select collection, item_id, cast(row_number() over (partition by collection, minx order by dt, item_id) as int) as pos, {r('minx')} from items""")
def time_ordered_items(spark, d):
    return q.time_ordered(b.items(spark, d), ["collection", "minx"]).select("collection", "item_id", "pos", "minx")


@query("datum_shift", f"""with {POINTS},
f as (select tile_id, x, y, row_number() over (partition by tile_id order by pid) as rn from points),
o as (select tile_id, case when (cast(floor(y / 2.5) as int) + cast(floor(x / 2.5) as int)) % 3 = 0 then null
   else -30.5 - cast(floor(y / 2.5) as int) * 0.25 - cast(floor(x / 2.5) as int) * 0.125 end as dz from f where rn = 1)
select tile_id, {r('min(z + coalesce(dz, 0))', 'z_min')}, {r('max(z + 31.8684)', 'z_const')} from points left join o using (tile_id) group by 1""")
def datum_shift(spark, d):
    p = b.points(spark, d)
    cell = lambda c: F.floor(F.col(c) / 2.5).cast("int")
    model = p.select(cell("y").alias("row"), cell("x").alias("col")).distinct().where((F.col("row") + F.col("col")) % 3 != 0)
    model = model.withColumn("dz", F.lit(-30.5) - F.col("row") * 0.25 - F.col("col") * 0.125)
    moved = cat.offset_per_cloud(p, cat.cell_offsets(p, model, 2.5))
    const = cat.offset_per_cloud(p).groupBy("tile_id").agg(F.max("z").alias("z_const"))
    return moved.groupBy("tile_id").agg(F.min("z").alias("z_min")).join(const, "tile_id")


@query("sampled_tiles", f"""with {TILES} select tile_id from tiles order by {draw("'123'", 'tile_id')}, tile_id limit 20""")
def sampled_tiles(spark, d):
    return tl.sample_tiles(b.tiles(spark, d), 20, "123").select("tile_id")


# --- scalar functions --------------------------------------------------------


@query("box_functions", f"""with {TILES}
select tile_id, {r('floor(xmin / 4) * 4', 'sx0')}, {r('floor(ymin / 4) * 4', 'sy0')}, {r('ceil(xmax / 4) * 4', 'sx1')}, {r('ceil(ymax / 4) * 4', 'sy1')},
  {r('(xmin + xmax) / 2 - (xmax - xmin)', 'ex0')}, {r('(ymin + ymax) / 2 + (ymax - ymin)', 'ey1')},
  printf('POLYGON((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))', xmin, ymin, xmax, ymin, xmax, ymax, xmin, ymax, xmin, ymin) as wkt,
  '{{"type":"Polygon","coordinates":[[[' || xmin || ',' || ymin || '],[' || xmax || ',' || ymin || '],[' || xmax || ',' || ymax || '],[' || xmin || ',' || ymax || '],[' || xmin || ',' || ymin || ']]]}}' as geojson
from tiles""")
def box_functions(spark, d):
    box = geo.box_columns()
    s, e = geo.snap_out(box, 4.0), geo.expand(box)
    return b.tiles(spark, d).select(
        "tile_id", s["xmin"].alias("sx0"), s["ymin"].alias("sy0"), s["xmax"].alias("sx1"), s["ymax"].alias("sy1"),
        e["xmin"].alias("ex0"), e["ymax"].alias("ey1"), geo.box_wkt(box).alias("wkt"), geo.box_geojson(box).alias("geojson"),
    )


@query("utm_codes", """with c as (select c_custkey, ((c_custkey * 7919) % 3600) / 10.0::double - 180 as lon, ((c_custkey * 104729) % 1600) / 10.0::double - 80 as lat from customer)
select c_custkey, cast(trunc((lon + 180) / 6) as int) + 1 as zone,
  case when lat >= 0 then 'EPSG:326' else 'EPSG:327' end || lpad(cast(cast(trunc((lon + 180) / 6) as int) + 1 as varchar), 2, '0') as epsg from c""")
def utm_codes(spark, d):
    c = b.table(spark, d, "customer").selectExpr(
        "c_custkey", "((c_custkey * 7919) % 3600) / 10.0D - 180 as lon", "((c_custkey * 104729) % 1600) / 10.0D - 80 as lat"
    )
    return c.select("c_custkey", geo.utm_zone(F.col("lon")).alias("zone"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def _lonlat(spark, d):
    return b.table(spark, d, "customer").selectExpr(
        "c_custkey", "((c_custkey * 7919) % 599) / 100.0D - 120 as lon", "((c_custkey * 104729) % 6997) / 100.0D + 1 as lat"
    )


def _utm_sql():
    import math

    n, rect, fwd, _, _ = geo._series()
    e2 = 2.0 * math.sqrt(n) / (1.0 + n)
    east = "eta" + "".join(f" + {a!r}::double * cos({2 * j} * xi) * ((exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2)" for j, a in enumerate(fwd, 1))
    north = "xi" + "".join(f" + {a!r}::double * sin({2 * j} * xi) * ((exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2)" for j, a in enumerate(fwd, 1))
    at = lambda e: f"(0.5 * ln((1 + {e}) / (1 - {e})))"
    return f"""with c as (select c_custkey, ((c_custkey * 7919) % 599) / 100.0::double - 120 as lon, ((c_custkey * 104729) % 6997) / 100.0::double + 1 as lat from customer),
a as (select c_custkey, sin(radians(lat)) as s, radians(lon + 117) as lam from c),
t as (select c_custkey, lam, {at('s')} - {e2!r}::double * {at(f'({e2!r}::double * s)')} as q from a),
u as (select c_custkey, lam, (exp(q) - exp(-q)) / 2 as t from t),
w as (select c_custkey, atan2(t, cos(lam)) as xi, {at('(sin(lam) / sqrt(1 + t * t))')} as eta from u)
select c_custkey, round(500000 + {0.9996 * rect!r}::double * ({east}), 3) + 0.0 as x, round({0.9996 * rect!r}::double * ({north}), 3) + 0.0 as y from w"""


@query("utm_coordinates", _utm_sql())
def utm_coordinates(spark, d):
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 11)
    return _lonlat(spark, d).select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("utm_round_trip", """select c_custkey, round(((c_custkey * 7919) % 599) / 100.0::double - 120, 6) + 0.0 as lon,
  round(((c_custkey * 104729) % 6997) / 100.0::double + 1, 6) + 0.0 as lat from customer""")
def utm_round_trip(spark, d):
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 11)
    there = _lonlat(spark, d).select("c_custkey", x.alias("x"), y.alias("y"))
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"), 11)
    return there.select("c_custkey", lon.alias("lon"), lat.alias("lat"))


def _degrees_sql():
    _, rect, _, inv, lat = geo._series()
    xi = "xi0" + "".join(f" - {k!r}::double * sin({2 * j} * xi0) * ((exp({2 * j} * eta0) + exp(-{2 * j} * eta0)) / 2)" for j, k in enumerate(inv, 1))
    eta = "eta0" + "".join(f" - {k!r}::double * cos({2 * j} * xi0) * ((exp({2 * j} * eta0) - exp(-{2 * j} * eta0)) / 2)" for j, k in enumerate(inv, 1))
    phi = "chi" + "".join(f" + {k!r}::double * sin({2 * j} * chi)" for j, k in enumerate(lat, 1))
    return f"""with {TILES}, moved as (select tile_id, xmin + 450000 as xmin, ymin + 3800000 as ymin, xmax + 450000 as xmax, ymax + 3800000 as ymax from tiles),
s as (select unnest(range(21)) / 20.0::double as s),
edge as (select tile_id, xmin + (xmax - xmin) * s as x, ymin as y from moved, s union all select tile_id, xmin + (xmax - xmin) * s, ymax from moved, s
  union all select tile_id, xmin, ymin + (ymax - ymin) * s from moved, s union all select tile_id, xmax, ymin + (ymax - ymin) * s from moved, s),
a as (select tile_id, y / {0.9996 * rect!r}::double as xi0, (x - 500000) / {0.9996 * rect!r}::double as eta0 from edge),
c as (select tile_id, {xi} as xi, {eta} as eta from a),
e as (select tile_id, xi, (exp(eta) - exp(-eta)) / 2 as sh, asin(sin(xi) / ((exp(eta) + exp(-eta)) / 2)) as chi from c),
ll as (select tile_id, -117 + degrees(atan2(sh, cos(xi))) as lon, degrees({phi}) as lat from e)
select tile_id, {r('min(lon)', 't_xmin')}, {r('min(lat)', 't_ymin')}, {r('max(lon)', 't_xmax')}, {r('max(lat)', 't_ymax')} from ll group by 1"""


@query("boxes_in_degrees", _degrees_sql())
def boxes_in_degrees(spark, d):
    moved = b.tiles(spark, d).select(
        "tile_id", *[(F.col(c) + o).alias(c) for c, o in zip(sp.BOX, (450000.0, 3800000.0) * 2)]
    )
    return geo.transform_box(moved, lambda x, y: geo.to_lonlat(x, y, 11), geo.box_columns()).select(
        "tile_id", "t_xmin", "t_ymin", "t_xmax", "t_ymax"
    )


@query("rescaled_values", f"""with {POINTS}
select pid, {r('least(greatest(0.1 + (z - 2) * (0.9 / 13.0), 0.1), 1.0)', 'scaled')}, 0.1::double as flat from points""")
def rescaled_values(spark, d):
    z = F.col("z")
    return b.points(spark, d).select(
        "pid", v.rescale(z, 2.0, 15.0).alias("scaled"), v.rescale(z, 3.0, 3.0).alias("flat")
    )


@query("sun_distance", f"""select o_orderkey, {r('1 - 0.01672 * cos(radians(0.9856 * (dayofyear(o_orderdate) - 4)))', 'au')} from orders""")
def sun_distance(spark, d):
    return b.table(spark, d, "orders").select("o_orderkey", v.earth_sun_distance(F.col("o_orderdate")).alias("au"))


@query("cyclic_time", f"""select o_orderkey, {r('sin(weekofyear(o_orderdate) * 2 * pi() / 52)', 'week_sin')}, {r('cos(weekofyear(o_orderdate) * 2 * pi() / 52)', 'week_cos')},
  {r('sin(hour(o_orderdate) * 2 * pi() / 24)', 'hour_sin')}, {r('cos(hour(o_orderdate) * 2 * pi() / 24)', 'hour_cos')},
  {r('sin(radians(o_custkey % 90))', 'lat_sin')}, {r('cos(radians(o_custkey % 90))', 'lat_cos')},
  {r('sin(radians(o_orderkey % 180))', 'lon_sin')}, {r('cos(radians(o_orderkey % 180))', 'lon_cos')} from orders""")
def cyclic_time(spark, d):
    codes = v.week_hour_encoding(F.col("o_orderdate"))
    codes |= v.lat_lon_encoding(F.col("o_custkey") % 90, F.col("o_orderkey") % 180)
    return b.table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in codes.items()])


@query("parsed_dates", """with t as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d')
  when 1 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') when 2 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' else 'soon' end as s from orders)
select o_orderkey, case when s <> 'soon' then cast(substr(s, 1, 10) as date) end as day,
  case when s <> 'soon' then cast(date_diff('day', date '1998-01-01', cast(substr(s, 1, 10) as date)) as float) end as rel from t""")
def parsed_dates(spark, d):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, stamp)
    text = text.when(k == 2, F.concat(stamp, F.lit("Z"))).otherwise(F.lit("soon"))
    day = v.parse_date(F.col("s"))
    return b.table(spark, d, "orders").select("o_orderkey", text.alias("s")).select(
        "o_orderkey", F.to_date(day).alias("day"), v.relative_days(day, F.lit("1998-01-01").cast("date")).alias("rel")
    )


@query("pixel_coordinates", f"""with {PIXELS}
select event_id, {r('100 + col * 0.5', 'mx')}, {r('900 - row * 0.5', 'my')}, row as back_row, col as back_col from pixels""")
def pixel_coordinates(spark, d):
    px = b.pixels(spark, d)
    x, y = geo.pixel_to_map(F.col("row"), F.col("col"), F.lit(100.0), F.lit(900.0), 0.5)
    row, col = geo.map_to_pixel(F.col("mx") + 0.25, F.col("my") - 0.25, F.lit(100.0), F.lit(900.0), 0.5)
    return px.select("event_id", x.alias("mx"), y.alias("my")).select("*", row.alias("back_row"), col.alias("back_col"))


@query("grid_index", f"""with {POINTS}
select pid, {rr('x', 'y')}, least(cast(trunc(least(greatest((y - 2) / 6, 0), 1) * 4) as int), 3) * 4 + least(cast(trunc(least(greatest((x - 2) / 6, 0), 1) * 4) as int), 3) as ix
from points""")
def grid_index(spark, d):
    from tileloom.operators.grid import fixed_box
    from tileloom.operators.normalize import grid_index as index

    return b.points(spark, d).select("pid", "x", "y", index(F.col("x"), F.col("y"), fixed_box(2, 2, 8, 8), 4).alias("ix"))
