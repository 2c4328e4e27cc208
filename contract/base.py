"""Registry, rounding and the table definitions the oracle SQL starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tileloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(tune(spark), folder))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, negative zero to zero."""
    return df.select(*[
        (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """The same rounding in the oracle's SQL."""
    return f"round(cast({expr} as double), {digits}) + 0.0 as {name or expr}"


def rr(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def draw(*keys: str) -> str:
    """A hash draw in the oracle's SQL; keys are SQL expressions."""
    text = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::bigint / 4294967296.0::double)"


POINTS = """points as (
  select 'tile_' || cast(l_suppkey as varchar) as tile_id,
    case when l_linenumber % 4 = 0 then 'dep' else 'uav' end as cloud,
    (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as pid,
    ((l_orderkey * 7919 + l_partkey * 31) % 10007) / 1000.7::double as x,
    ((l_partkey * 104729 + l_orderkey * 17) % 10009) / 1000.9::double as y,
    l_extendedprice / 4987.3::double as z,
    l_quantity as intensity, cast(l_linenumber as double) as return_number,
    7.0::double as number_of_returns,
    case when l_returnflag = 'R' then 2 when l_linestatus = 'F' then 7 else 1 end as classification,
    l_extendedprice / 4987.3::double as hag, l_suppkey as suppkey, l_tax as tax, l_discount as discount
  from lineitem)"""

#: The same points with each tile's clouds as tiles of their own, for operators that take one cloud.
CLOUD_POINTS = POINTS.replace("points as (", "both_clouds as (", 1) + """,
points as (select * replace (tile_id || '/' || cloud as tile_id) from both_clouds)"""

WORLD_POINTS = POINTS + """, world as (
  select cloud, pid, x + 10.0::double * (suppkey % 10) as x,
    y + 10.0::double * (suppkey // 10) as y, z from points)"""

TILES = """tiles as (
  select 'tile_' || cast(s_suppkey as varchar) as tile_id, s_name as source,
    10.0::double * (s_suppkey % 10) - 0.75::double as xmin, 10.0::double * (s_suppkey // 10) - 0.75::double as ymin,
    10.0::double * (s_suppkey % 10) + 10.75::double as xmax, 10.0::double * (s_suppkey // 10) + 10.75::double as ymax
  from supplier)"""

LOCAL_TILES = """tiles as (
  select 'tile_' || cast(s_suppkey as varchar) as tile_id,
    0.0::double as xmin, 0.0::double as ymin, 10.0::double as xmax, 10.0::double as ymax from supplier)"""

ITEMS = """items as (
  select cast(o_orderkey as varchar) as item_id, o_orderpriority as collection, o_orderdate as dt,
    cast(o_custkey % 100 as double) as minx, cast((o_custkey * 7) % 100 as double) as miny,
    cast(o_custkey % 100 + 5 + o_orderkey % 20 as double) as maxx,
    cast((o_custkey * 7) % 100 + 5 + o_orderkey % 20 as double) as maxy,
    o_orderkey as orderkey, o_totalprice as price, o_orderstatus as status
  from orders)"""

POLYS = """polys_c as (
  select 'poly_' || cast(n_nationkey as varchar) as poly_id,
    ((n_nationkey * 37) % 100) + 3.25::double as cx, ((n_nationkey * 53) % 100) + 2.75::double as cy,
    6.5::double + (n_nationkey % 7) * 2.5::double as r from nation),
polys as (
  select poly_id, cx + r as x1, cy as y1, cx as x2, cy + 0.8::double * r as y2 from polys_c
  union all select poly_id, cx, cy + 0.8::double * r, cx - r, cy from polys_c
  union all select poly_id, cx - r, cy, cx, cy - 0.8::double * r from polys_c
  union all select poly_id, cx, cy - 0.8::double * r, cx + r, cy from polys_c)"""

PIXELS = """pixels as (
  select 'tile_' || cast(user_id as varchar) as tile_id,
    case when event_id % 3 = 0 then 'naip' else 'uavsar' end as sensor,
    'img_' || cast(user_id as varchar) || '_' || cast(event_id // 16 as varchar) as image_id,
    cast(ts as date) as dt, event_type as band,
    cast(event_id % 4 as int) as row, cast((event_id // 4) % 4 as int) as col,
    case when event_id % 97 = 0 then 'NaN'::double when event_id % 101 = 0 then 'Infinity'::double
      else value end as v, event_id, user_id
  from events)"""

EVAL = """eval as (
  select 'tile_' || cast(p_partkey as varchar) as tile_id,
    ((p_partkey * 7919) % 1009 + 1) / 100.0::double as input_chamfer_distance,
    ((p_partkey * 7919) % 1009 + (p_partkey * 31) % 211 + 1) / 250.0::double as baseline_chamfer_distance,
    ((p_partkey * 7919) % 1009 + (p_partkey * 37) % 223 + 1) / 260.0::double as naip_chamfer_distance,
    ((p_partkey * 7919) % 1009 + (p_partkey * 41) % 227 + 1) / 255.0::double as uavsar_chamfer_distance,
    case when p_partkey % 89 = 0 then 'Infinity'::double when p_partkey % 83 = 0 then 'NaN'::double
      else ((p_partkey * 7919) % 1009 + (p_partkey * 43) % 229 + 1) / 270.0::double end as combined_chamfer_distance,
    ((p_partkey * 7919) % 1009 - 480 + (p_partkey * 13) % 97) / 50.0::double as net_canopy_height_change,
    ((p_partkey * 17) % 251) / 10.0::double as gt_max_z, ((p_partkey * 19) % 127) / 20.0::double as gt_z_std
  from part)"""


def finite(v: str) -> str:
    return f"({v} is not null and not isnan({v}) and not isinf({v}))"
