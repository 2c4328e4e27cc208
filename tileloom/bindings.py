"""Our tables derived from the star-schema test tables.

Integer arithmetic first, one division last, so that another engine gets the
same doubles. One tile per supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "concat('tile_', cast(l_suppkey as string)) as tile_id",
        "case when l_linenumber % 4 = 0 then 'dep' else 'uav' end as cloud",
        "(l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as pid",
        "((l_orderkey * 7919 + l_partkey * 31) % 10007) / 1000.7D as x",
        "((l_partkey * 104729 + l_orderkey * 17) % 10009) / 1000.9D as y",
        "l_extendedprice / 4987.3D as z",
        "l_quantity as intensity",
        "cast(l_linenumber as double) as return_number",
        "7.0D as number_of_returns",
        "case when l_returnflag = 'R' then 2 when l_linestatus = 'F' then 7 else 1 end as classification",
        "l_extendedprice / 4987.3D as hag",
        "l_suppkey as suppkey",
        "l_tax as tax",
        "l_discount as discount",
    )


def cloud_points(spark: SparkSession, folder: str) -> DataFrame:
    """The same points with each tile's clouds as tiles of their own, for operators that take one cloud."""
    return points(spark, folder).withColumn("tile_id", F.concat_ws("/", "tile_id", "cloud"))


def world_points(spark: SparkSession, folder: str) -> DataFrame:
    """The same points placed side by side on a common plane, ten tiles per line."""
    return points(spark, folder).selectExpr(
        "cloud", "pid", "x + 10.0D * (suppkey % 10) as x", "y + 10.0D * (suppkey div 10) as y", "z"
    )


def tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes on the common plane, widened by 0.75 m so that neighbours overlap."""
    return table(spark, folder, "supplier").selectExpr(
        "concat('tile_', cast(s_suppkey as string)) as tile_id",
        "s_name as source",
        "10.0D * (s_suppkey % 10) - 0.75D as xmin",
        "10.0D * (s_suppkey div 10) - 0.75D as ymin",
        "10.0D * (s_suppkey % 10) + 10.75D as xmax",
        "10.0D * (s_suppkey div 10) + 10.75D as ymax",
    )


def local_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes in the tiles' own coordinates."""
    return table(spark, folder, "supplier").selectExpr(
        "concat('tile_', cast(s_suppkey as string)) as tile_id",
        "0.0D as xmin", "0.0D as ymin", "10.0D as xmax", "10.0D as ymax",
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "cast(o_orderkey as string) as item_id",
        "o_orderpriority as collection",
        "o_orderdate as dt",
        "cast(o_custkey % 100 as double) as minx",
        "cast((o_custkey * 7) % 100 as double) as miny",
        "cast(o_custkey % 100 + 5 + o_orderkey % 20 as double) as maxx",
        "cast((o_custkey * 7) % 100 + 5 + o_orderkey % 20 as double) as maxy",
        "o_orderkey as orderkey",
        "o_totalprice as price",
        "o_orderstatus as status",
    )


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """A lozenge around a lattice point for every nation."""
    corner = (
        table(spark, folder, "nation")
        .selectExpr(
            "n_nationkey as poly",
            "((n_nationkey * 37) % 100) + 3.25D as cx",
            "((n_nationkey * 53) % 100) + 2.75D as cy",
            "6.5D + (n_nationkey % 7) * 2.5D as r",
        )
        .selectExpr(
            "concat('poly_', cast(poly as string)) as poly_id",
            "array(struct(0 as s, cx + r as x1, cy as y1, cx as x2, cy + 0.8D * r as y2), "
            "struct(1 as s, cx as x1, cy + 0.8D * r as y1, cx - r as x2, cy as y2), "
            "struct(2 as s, cx - r as x1, cy as y1, cx as x2, cy - 0.8D * r as y2), "
            "struct(3 as s, cx as x1, cy - 0.8D * r as y1, cx + r as x2, cy as y2)) as ring",
        )
    )
    return corner.select("poly_id", F.lit(0).alias("ring_ix"), F.explode("ring").alias("e")).select(
        "poly_id", "ring_ix", F.col("e.s").alias("seg_ix"), "e.x1", "e.y1", "e.x2", "e.y2"
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels of dated images, one tile per user, with NaN and infinities mixed in."""
    return table(spark, folder, "events").selectExpr(
        "concat('tile_', cast(user_id as string)) as tile_id",
        "case when event_id % 3 = 0 then 'naip' else 'uavsar' end as sensor",
        "concat('img_', cast(user_id as string), '_', cast(event_id div 16 as string)) as image_id",
        "to_date(ts) as dt",
        "event_type as band",
        "cast(event_id % 4 as int) as row",
        "cast((event_id div 4) % 4 as int) as col",
        "case when event_id % 97 = 0 then double('NaN') when event_id % 101 = 0 then double('Infinity') "
        "else value end as v",
        "event_id",
        "user_id",
    )


def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part: five error columns and a height change."""
    return table(spark, folder, "part").selectExpr(
        "concat('tile_', cast(p_partkey as string)) as tile_id",
        "((p_partkey * 7919) % 1009 + 1) / 100.0D as input_chamfer_distance",
        "((p_partkey * 7919) % 1009 + (p_partkey * 31) % 211 + 1) / 250.0D as baseline_chamfer_distance",
        "((p_partkey * 7919) % 1009 + (p_partkey * 37) % 223 + 1) / 260.0D as naip_chamfer_distance",
        "((p_partkey * 7919) % 1009 + (p_partkey * 41) % 227 + 1) / 255.0D as uavsar_chamfer_distance",
        "case when p_partkey % 89 = 0 then double('Infinity') when p_partkey % 83 = 0 then double('NaN') "
        "else ((p_partkey * 7919) % 1009 + (p_partkey * 43) % 229 + 1) / 270.0D end as combined_chamfer_distance",
        "((p_partkey * 7919) % 1009 - 480 + (p_partkey * 13) % 97) / 50.0D as net_canopy_height_change",
        "((p_partkey * 17) % 251) / 10.0D as gt_max_z",
        "((p_partkey * 19) % 127) / 20.0D as gt_z_std",
    )
