"""A caller's statistics as partial states, exact numbering and chunks, the attempts ledger."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tileloom.operators import cell_states, quality, ranks
from tileloom.sources import attempts, tiles


def cells(spark, n=3000, parts=7):
    return spark.range(n).selectExpr(
        "case when id % 3 = 0 then 't0' else concat('t', id % 40) end as tile_id", "cast(id % 2 as int) as row", "cast(0 as int) as col",
        "case when id % 50 = 0 then null else cast(id * 7919 % 1009 as double) end as z", "'clash' as state",
    ).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("held", [2, 1 << 16])
def test_states_equal_the_whole_cell(spark, parts, held, monkeypatch):
    monkeypatch.setattr(cell_states, "HELD_CELLS", held)
    rows = cells(spark, parts=parts)
    own = {}
    for r in rows.collect():
        if r.z is not None:
            own.setdefault((r.tile_id, r.row, r.col), []).append(r.z)
    for share in (0.0, 0.1, 0.49):
        got = {r[:3]: r.v for r in cell_states.cell_statistic(rows, cell_states.TrimmedMean(share)).collect()}
        want = {}
        for key, values in own.items():
            values = sorted(values)
            cut = int(len(values) * share)
            want[key] = float(np.mean(values[cut : len(values) - cut]))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    bands = cell_states.cell_bands(rows, cell_states.LayerShares([100.0, 500.0]))
    seen = {}
    for r in bands.collect():
        seen.setdefault((r.tile_id, r.row, r.col), {})[r.band] = r.v
    for key, values in own.items():
        v = np.array(values)
        assert [seen[key][b] for b in range(3)] == pytest.approx([(v < 100).mean(), ((v >= 100) & (v < 500)).mean(), (v >= 500).mean()])


def test_only_states_are_shuffled(spark):
    class Counted:
        """How many values a cell has, and how many states they came in."""

        def state(self, values):
            return len(values), 1

        def merge(self, a, b):
            # Inside a task states are merged batch by batch; that counts as one.
            return a[0] + b[0], a[1] + b[1]

        def finish(self, state):
            return state

    plan = cell_states.cell_statistic(cells(spark), cell_states.TrimmedMean(0.1))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(tile_id") < plan.rindex("MapInArrow")
    states = cell_states.statistic_per_cell(cells(spark, 20000, 4).withColumn("tile_id", F.lit("hot")), ["tile_id"], "z", Counted())
    assert states.first().bands == [19600.0, 4.0]


def test_few_values_of_a_cell_become_one_state(spark):
    class States:
        def state(self, values):
            return 1

        def merge(self, a, b):
            return a + b

        def finish(self, state):
            return float(state)

    counted = cell_states.cell_statistic(cells(spark, 3000, 7), States(), "z")
    assert {r.v for r in counted.collect()} == {1.0}


def test_no_values_and_other_keys(spark):
    rows = cells(spark).where("z is null")
    assert cell_states.cell_statistic(rows, cell_states.TrimmedMean(0.1)).collect() == []
    assert cell_states.cell_statistic(cells(spark).limit(0), cell_states.TrimmedMean(0.1)).collect() == []
    keyed = spark.createDataFrame([(1, None, 2.0), (1, None, 4.0), (None, "x", 5.0)], "a long, b string, v double")
    got = {(r.a, r.b): r.v for r in cell_states.cell_statistic(keyed, cell_states.TrimmedMean(0.0), "v", ["a", "b"]).collect()}
    assert got == {(1, None): 3.0, (None, "x"): 5.0}
    with pytest.raises(ValueError):
        cell_states.TrimmedMean(0.5)


@pytest.mark.parametrize("parts", [1, 9])
def test_numbers_are_exact(spark, parts):
    rows = spark.range(1000).selectExpr("concat('k', id * 7 % 1000) as k", "case when id % 10 < 7 then 'hot' when id % 10 = 7 then null else 'cold' end as g", "id as _at").repartition(parts)
    got = {r.k: r.number for r in ranks.numbered(rows, ["k"]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1000))
    inside = ranks.numbered_within(rows, ["g"], ["k"])
    assert inside.columns == ["k", "g", "_at", "number"]
    by_group = {}
    for r in inside.collect():
        by_group.setdefault(r.g, []).append((r.k, r.number))
    for own in by_group.values():
        assert [n for _, n in sorted(own)] == list(range(len(own)))
    assert ranks.numbered(rows.limit(0), ["k"]).count() == 0


def test_time_order_of_a_hot_tile(spark):
    rows = spark.range(500).selectExpr("'t' as tile_id", "date_add(date'2024-01-01', cast(id % 9 as int)) as dt", "concat('i', id) as item_id").repartition(5)
    got = [(r.dt, r.item_id) for r in sorted(quality.time_ordered(rows, ["tile_id"]).collect(), key=lambda r: r.pos)]
    assert got == sorted(got) and len(got) == 500


def test_chunks_hold_exactly_n_tiles(spark, tmp_path):
    rows = spark.range(5000).selectExpr("case when id % 2 = 0 then 't000' else concat('t', lpad(id % 103, 3, '0')) end as tile_id", "id as v")
    out = str(tmp_path / "chunks")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tiles.write_chunks(rows, out, 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = tiles.read_chunks(spark, out)
    n = {r.chunk_ix: r.n for r in back.groupBy("chunk_ix").agg(F.count_distinct("tile_id").alias("n")).collect()}
    assert [n[k] for k in sorted(n)] == [10] * (len(n) - 1) + [103 % 10 or 10]
    assert back.select("tile_id", "v").exceptAll(rows).count() == 0 and back.count() == 5000
    assert back.where("chunk_ix <> tile_number div 10").count() == 0
    # The rows of the tile with half of all rows are in several files of its chunk.
    assert back.where("tile_id = 't000'").select("source_file").distinct().count() > 1


def test_ledger_commits_once(spark, tmp_path):
    path = str(tmp_path / "log")
    assert attempts.read_ledger(spark, path).count() == 0
    first = spark.createDataFrame([("a", None), ("b", "late")], "tile_id string, reason string")
    assert attempts.commit(path, 1, 1, first)
    assert not attempts.commit(path, 1, 1, first.withColumn("reason", F.lit("other")))
    log = attempts.read_ledger(spark, path)
    assert sorted(map(tuple, log.collect()), key=str) == [("a", "succeeded", None, 1, 1), ("b", "failed", "late", 1, 1)]
    assert attempts.commit(path, 1, 2, spark.createDataFrame([("b", None)], "tile_id string, reason string"))
    views = [{r.tile_id: (r.status, r.n_attempts) for r in attempts.as_of(attempts.read_ledger(spark, path), *at).collect()} for at in ((1, 1), ())]
    assert views == [{"a": ("succeeded", 1), "b": ("failed", 1)}, {"a": ("succeeded", 1), "b": ("succeeded", 2)}]


def test_failed_tiles_run_again(spark, tmp_path):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "tile_id string")
    asked = []

    def work(todo, attempt):
        names = sorted(r.tile_id for r in todo.collect())
        asked.append(names)
        if attempt == 2:
            raise ConnectionError("gone")
        done = [(n, None if n == "a" or attempt == 3 and n == "b" else "bad") for n in names if n != "d"]
        return spark.createDataFrame(done, "tile_id string, reason string")

    path = str(tmp_path / "log")
    got = {r.tile_id: (r.status, r.reason, r.n_attempts) for r in attempts.run_attempts(path, 1, wanted, work, 3).collect()}
    assert asked == [["a", "b", "c", "d"], ["b", "c", "d"], ["b", "c", "d"]]
    assert got == {"a": ("succeeded", None, 1), "b": ("succeeded", None, 3), "c": ("failed", "bad", 3), "d": ("failed", "no_result", 3)}
    again = attempts.run_attempts(path, 1, wanted, work, 3)
    assert len(asked) == 3 and {r.tile_id: r.n_attempts for r in again.collect()} == {k: v[2] for k, v in got.items()}
    attempts.run_attempts(path, 2, wanted, lambda todo, _: todo.select("tile_id", F.lit(None).cast("string").alias("reason")), 3)
    log = attempts.read_ledger(spark, path)
    assert attempts.open_tiles(wanted, log).count() == 0 and log.where("run = 2").count() == 2


def test_an_error_fails_its_own_tile(spark):
    def one(rows):
        if rows["v"].sum() < 0:
            raise ValueError("negative")

    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -5.0)], "tile_id string, v double")
    got = rows.groupBy("tile_id").applyInPandas(attempts.guarded(one), "tile_id string, reason string")
    assert {r.tile_id: r.reason for r in got.collect()} == {"a": None, "b": "ValueError: negative"}
