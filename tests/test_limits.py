"""What one machine must hold: broadcasts built on the driver."""

import pytest

from pyspark.sql import functions as F

from tileloom.operators import augment
from tileloom.session import MOST_BROADCAST, tune

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


@pytest.mark.parametrize("own, then", [("256k", "256k"), ("-1", "-1"), ("32MB", str(MOST_BROADCAST)), ("10485760b", str(MOST_BROADCAST))])
def test_tuning_never_raises_the_sessions_broadcast_limit(spark, own, then):
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, own)
        assert tune(spark).conf.get(LIMIT) == then
    finally:
        spark.conf.set(LIMIT, before)


def test_a_tuned_session_broadcasts_no_table_of_ten_megabytes(spark):
    tune(spark)
    many = spark.range(600_000).selectExpr("id", "id * 2.0D as x")
    plan = many.join(many.withColumnRenamed("x", "y"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_masking_reads_its_points_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    made = spark.range(400).selectExpr(
        "concat('t', id % 2) as tile_id", "id as pid", "double(id % 20) as x", "double(id div 20) as y", "double(id % 7) as z"
    )
    points = made.mapInArrow(seen, made.schema)
    left = augment.mask_points(points, "1", 1.0, 5.0)
    assert 200 < left.count() < 400 and left.join(made, left.columns, "left_anti").isEmpty()
    assert reads.value == 400


def test_a_packed_file_of_many_rows_is_not_broadcast(spark, tmp_path):
    tune(spark)
    spark.range(600_000).selectExpr("pmod(xxhash64(id), 1000) as k").write.parquet(f"{tmp_path}/packed")
    packed = spark.read.parquet(f"{tmp_path}/packed")
    long = packed.selectExpr("k", "explode(array(1, 2, 3)) as part")
    plan = spark.range(2_000_000).join(long, F.col("id") == F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
