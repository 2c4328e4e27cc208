"""Connected components of an edge list, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tileloom.session import cut_lineage


#: Edges that one task handles; a smaller list is not spread over all partitions.
TASK_EDGES = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round is aggregates and equi-joins; a node with very many neighbours is a skewed join key,
    which Spark splits. The number of rounds grows with the logarithm of a component's size. A round
    uses as many partitions as its edges fill, so that short lists do not leave many small files.
    """
    state = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        size = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            break
        before, parts = size, -(-size[0] // TASK_EDGES)
        state = cut_lineage(small_star(large_star(state.coalesce(parts), parts), parts))
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    handed = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.coalesce(parts).distinct().coalesce(parts)


def small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    every = handed.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
    return every.coalesce(parts).distinct().coalesce(parts)
