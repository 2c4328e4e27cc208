"""One group with nearly all rows is not one task's when its values meet their bounds."""

import pytest
from pyspark.sql import functions as F

from tileloom.operators import ranks


@pytest.fixture
def plain_joins(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_of_a_hot_key_are_in_several_tasks(spark, monkeypatch, plain_joins):
    rows = spark.range(4000).selectExpr("'hot' as g", "cast(id as double) as v").unionByName(
        spark.range(3).selectExpr("concat('g', id) as g", "1.0D as v")
    )
    want = sorted(map(tuple, ranks.width_bucket(rows, ["g"], "v", "b", 100).collect()))
    monkeypatch.setattr(ranks, "ROWS_MET", 50, raising=False)
    made = ranks.width_bucket(rows, ["g"], "v", "b", 100)
    assert made.columns == ["g", "v", "b"] and sorted(map(tuple, made.collect())) == want
    held = made.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert held < 3000


def test_ranks_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_MET", 50, raising=False)
    rows = spark.range(3000).selectExpr("cast(id % 2 = 0 or id % 3 = 0 as int) as g", "cast(id * 7919 % 701 as double) as v")
    seen = {}
    for r in rows.collect():
        seen.setdefault(r.g, []).append(r.v)
    got = {(r["g"], r["v"]): (r["c"], r["rank"]) for r in ranks.average_ranks(rows, ["g"], "v").collect()}
    want = {}
    for g, vs in seen.items():
        for v in set(vs):
            below, c = sum(x < v for x in vs), vs.count(v)
            want[(g, v)] = (c, below + (c + 1) / 2)
    assert got == want
