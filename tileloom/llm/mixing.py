"""Mixing sources to target weights by entropy balancing (operator 3).

A document's rate is how often the mix takes it. The rates of a source differ as little as possible
from one (in relative entropy) among those that reach the source's target of words and stay within
``MOST``; the dual of that problem has one multiplier per source, and its solution is
rate = min(MOST, exp(multiplier * size)): long documents gain where the target is above the source's
size, short ones where it is below. Newton's method finds all multipliers at once; each iteration is
one aggregate over the (source, size) table, to which all documents were first summed up exactly.

Rates are rounded to whole copies by carrying the error on. Along the sizes of a source, longest
first, the copies of all documents of one size are the nearest whole number to what their rates
and the words still owed ask for; so what is owed at the end is about half a short document. The
copies of one size are spread over its documents, which differ by one at most.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tileloom.llm import common as c
from tileloom.session import cut_lineage

#: No document is taken more often, and no target exceeds so many times the source's size.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Relative gap of a source's words at which Newton's method ends, and its iterations at most.
GAP, ITERATIONS = 1e-9, 100
#: Documents of one source and size that are put in order by one task.
RUN = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of each text; null has none."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights go round the sources in order of code point, null last. A target stops at ``most`` times
    its source's size; the excess is shared again by weight until none is above. Works on one row
    per source.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # Sources reach their caps in order of cap over weight: find the first that needn't stop.
    rank = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = rank.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("share", (F.col("total") - F.col("capped")) / F.col("left"))
    )
    free = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("share")))).over(everything)["share"]
    target = F.least(F.col("cap"), F.coalesce(free, F.lit(float("inf"))) * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def rate(multiplier, size, most: int = MOST):
    """exp(multiplier * size), at most ``most``."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(multiplier * size, F.lit(10.0)))))


def multipliers(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, multiplier, full) from cells (source, size, n) and goals (source, source_size, target).

    ``full`` marks sources all of whose documents are taken ``most`` times. Newton's step is taken
    where it stays within the bracket known so far, which is halved (or doubled while open) elsewhere.
    """
    state = cut_lineage(
        goals.where("source_size > 0").select(
            "source", "target", F.lit(0.0).alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
            (1 / F.col("source_size").cast("double")).alias("step"),
        )
    )
    for _ in range(ITERATIONS):
        r = rate(F.col("multiplier"), F.col("size"), most)
        reached = (
            cells.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(
                F.sum(F.col("n") * F.col("size") * r).alias("words"),
                F.sum(F.when(r < most, F.col("n") * F.col("size") * F.col("size") * r).otherwise(0.0)).alias("slope"),
            )
        )
        now = state.join(reached, state["source"].eqNullSafe(reached["s"])).drop("s")
        over = F.col("words") - F.col("target")
        low = F.when(over <= 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.col("multiplier")).otherwise(F.col("high"))
        now = now.withColumns({"low": low, "high": high, "gap": F.when(F.col("full"), 0.0).otherwise(F.abs(over) / F.col("target"))})
        newton = F.col("multiplier") - over / F.col("slope")
        within = (F.col("slope") > 0) & (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        # A step that leaves the bracket, or one over a flat slope, is replaced.
        other = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).otherwise(
            F.col("multiplier") - F.signum(over) * F.col("step")
        )
        moved = F.when(F.col("gap") <= GAP, F.col("multiplier")).when(within, newton).otherwise(other)
        state = cut_lineage(now.withColumns({"multiplier": moved, "step": F.col("step") * 2}).drop("words", "slope"))
        if not state.where(F.col("gap") > GAP).limit(1).count():
            break
        state = state.drop("gap")
    return state.select("source", "multiplier", "full")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """How often each document is taken so that every source comes near its target of words.

    ``docs`` has doc_id, text and source; other columns are ignored. Returns one row per input row:
    doc_id, source, size, source_size, target, rate, copies and taken (copies times size). A null
    source is one of its own, last in order. A text without words is taken once and counts nothing.
    Order within a size is that of a hash of doc_id, so reruns agree.
    """
    rows = c.stage(sizes(docs))
    cells = cut_lineage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goals = cut_lineage(targets(totals, weights, most))
    solved = multipliers(cells, goals, most)

    goals, solved = goals.withColumnRenamed("source", "g"), solved.withColumnRenamed("source", "m")
    rated = (
        cells.join(goals, F.col("source").eqNullSafe(F.col("g")))
        .join(solved, F.col("source").eqNullSafe(F.col("m")), "left")
        .withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate(F.col("multiplier"), F.col("size"), most)))
        .withColumn("runs", F.ceil(F.col("n") / RUN))
        .select("source", "size", "n", "source_size", "target", "rate", "runs")
    )
    rated = rated.groupBy("source").applyInArrow(lambda key, rows: rounded(rows, most), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rated.schema)}, of_all long")
    # A cell with very many documents is put in order run by run; runs are parts of the hash's range.
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    placed = (
        rows.join(rated.withColumnsRenamed({"source": "s", "size": "z"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
        .drop("s", "z")
        .withColumn("draw", draw)
        .withColumn("run", F.least(F.floor(F.col("draw") / (2.0**63) * F.col("runs")), F.col("runs") - 1))
    )
    key = ["source", "size", "run"]
    runs = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("of_run"))
    earlier = Window.partitionBy("source", "size").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(k).alias("r_" + k) for k in key], F.coalesce(F.sum("of_run").over(earlier), F.lit(0)).alias("in_earlier"))
    inside = Window.partitionBy(*key).orderBy("draw", "doc_id")
    placed = placed.join(
        runs, placed["source"].eqNullSafe(runs["r_source"]) & (placed["size"] == runs["r_size"]) & (placed["run"] == runs["r_run"])
    ).withColumn("place", F.col("in_earlier") + F.row_number().over(inside))
    copies = F.expr("of_all div n") + (F.col("place") <= F.col("of_all") % F.col("n")).cast("long")
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def rounded(rows: pa.Table, most: int) -> pa.Table:
    """The cells of a source with ``of_all``, the copies of all documents of the cell."""
    rows = rows.sort_by([("size", "descending")])
    owed, out = 0.0, []
    for size, n, rate_of in zip(*(rows.column(x).to_pylist() for x in ("size", "n", "rate")), strict=True):
        if size:
            owed += n * rate_of * size
            out.append(min(most * n, max(0, math.floor(owed / size + 0.5))))
            owed -= out[-1] * size
        else:
            out.append(n)
    return rows.append_column("of_all", pa.array(out, pa.int64()))


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, rate, copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
