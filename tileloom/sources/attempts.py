"""The attempts ledger. Which tile was tried when, with what outcome; failed tiles are run again.

The ledger is a folder with one Parquet folder per (run, attempt). A commit is keyed by these two: one
that is already there adds nothing, and one that died before its rows were visible is written anew. Rows
are never changed; what holds for a tile at some time is a view over the attempts up to then.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LEDGER = "tile_id string, status string, reason string, run int, attempt int"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All attempts; none if nothing has been committed yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def commit(path: str, run: int, attempt: int, outcomes: DataFrame) -> bool:
    """Append the outcomes (tile_id, reason; null for success) of one attempt; False if it is there already."""
    log = read_ledger(outcomes.sparkSession, path)
    if not log.where((F.col("run") == run) & (F.col("attempt") == attempt)).isEmpty():
        return False
    status = F.when(F.col("reason").isNull(), F.lit("succeeded")).otherwise(F.lit("failed"))
    rows = outcomes.select(F.col("tile_id").cast("string").alias("tile_id"), status.alias("status"), F.col("reason").cast("string").alias("reason"))
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/attempt={attempt}")
    return True


def as_of(log: DataFrame, run: int | None = None, attempt: int | None = None) -> DataFrame:
    """One row per tile after the given run and attempt (all, if not given): status, reason, n_attempts.

    A tile that has succeeded once stays succeeded; any other has the reason of its last attempt.
    """
    if run is not None:
        at = F.struct(F.lit(run), F.lit(2**31 - 1 if attempt is None else attempt))
        log = log.where(F.struct("run", "attempt") <= at)
    order = F.struct((F.col("status") == "succeeded").cast("int"), "run", "attempt")
    return log.groupBy("tile_id").agg(
        F.max_by("status", order).alias("status"), F.max_by("reason", order).alias("reason"), F.count(F.lit(1)).alias("n_attempts")
    )


def open_tiles(tiles: DataFrame, log: DataFrame) -> DataFrame:
    """The tiles that have not succeeded yet."""
    done = log.where(F.col("status") == "succeeded").select("tile_id").distinct()
    return tiles.join(done, "tile_id", "left_anti")


def run_attempts(path: str, run: int, tiles: DataFrame, work: Callable[[DataFrame, int], DataFrame], most: int = 3) -> DataFrame:
    """Run ``work`` on the tiles, and again on those that failed, up to ``most`` times; the ledger's view.

    ``work`` gets the open tiles and the number of the attempt and returns (tile_id, reason): null for
    success. A tile that it leaves out has failed with ``no_result``; if the work itself raises, all of
    its tiles have failed with the error's name. A run that was broken off goes on where it stopped.
    """
    spark = tiles.sparkSession
    for attempt in range(1, most + 1):
        log = read_ledger(spark, path)
        before = log.where((F.col("run") < run) | (F.col("attempt") < attempt))
        todo = open_tiles(tiles.select("tile_id").distinct(), before)
        if todo.isEmpty():
            break
        if not log.where((F.col("run") == run) & (F.col("attempt") == attempt)).isEmpty():
            continue
        try:
            reasons = work(todo, attempt).groupBy("tile_id").agg(F.max("reason").alias("reason"), F.lit(True).alias("seen"))
            found = todo.join(reasons, "tile_id", "left")
            commit(path, run, attempt, found.select("tile_id", F.when(F.col("seen").isNull(), F.lit("no_result")).otherwise(F.col("reason")).alias("reason")))
        except Exception as error:  # the attempt is recorded, and its tiles are tried again
            commit(path, run, attempt, todo.select("tile_id", F.lit(type(error).__name__).alias("reason")))
    return as_of(read_ledger(spark, path))


def guarded(one_tile: Callable[[pd.DataFrame], None]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For ``groupBy("tile_id").applyInPandas(guarded(f), "tile_id string, reason string")``: an error fails its tile only."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            one_tile(rows)
            reason = None
        except Exception as error:
            reason = f"{type(error).__name__}: {error}"
        return pd.DataFrame({"tile_id": [rows["tile_id"].iloc[0]], "reason": [reason]})

    return run


def attempts_summary(log: DataFrame) -> DataFrame:
    """Tiles per run, attempt, status and reason."""
    return log.groupBy("run", "attempt", "status", "reason").agg(F.count(F.lit(1)).alias("n_tiles"))
