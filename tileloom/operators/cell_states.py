"""G1 and G11 with a caller's own statistic: partial states per cell, merged and finished.

Each task turns the values it reads into one state per cell; only states are shuffled. So the points
of a crowded cell never meet: its task merges one state for each task that saw the cell, one after
the other. How large a state is, is up to the statistic. If no cell is crowded, values are dealt by
cell first, and a cell has one state.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

#: Cells whose states a task holds before it hands them on.
HELD_CELLS = 1 << 16
#: A cell with more values than this is crowded: values become states where they lie.
VALUES_MET = 10_000


class Statistic(Protocol):
    """What a caller brings. ``finish`` returns a number, or a sequence of numbers as bands."""

    def state(self, values: np.ndarray) -> Any:
        """The state of some values of one cell; never called without values."""

    def merge(self, a: Any, b: Any) -> Any:
        """The state of all values of two states."""

    def finish(self, state: Any) -> float | Sequence[float] | None:
        """The cell's result."""


class TrimmedMean:
    """The mean without the lowest and the highest share of values. The state has each different value once."""

    def __init__(self, share: float):
        if not 0.0 <= share < 0.5:
            raise ValueError("share must be in [0, 0.5)")
        self.share = share

    def state(self, values):
        return np.unique(values, return_counts=True)

    def merge(self, a, b):
        values, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([a[1], b[1]])).astype(np.int64)

    def finish(self, state):
        values, counts = state
        upto = np.cumsum(counts)
        cut = int(upto[-1] * self.share)
        kept = np.clip(upto, cut, upto[-1] - cut)
        return float(np.sum(values * np.diff(kept, prepend=cut)) / (upto[-1] - 2 * cut))


class LayerShares:
    """The share of values in each layer between the bounds, from the lowest layer up, as bands."""

    def __init__(self, bounds: Sequence[float]):
        self.bounds = np.asarray(bounds, float)

    def state(self, values):
        return np.bincount(np.searchsorted(self.bounds, values, "right"), minlength=len(self.bounds) + 1)

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        return (state / state.sum()).tolist()


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=names)


def statistic_per_cell(cells: DataFrame, keys: list[str], value: str, statistic: Statistic) -> DataFrame:
    """``keys`` and ``bands``: the statistic of ``value`` over the rows of each key. Null values are left out."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = cells.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value_of_cell"))
    # Where no cell is crowded, its few values meet first: a state for every value or two costs more than the values.
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("values_of_cell"))
    if (sizes.agg(F.max("values_of_cell")).first()[0] or 0) <= VALUES_MET:
        rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    fields = StructType([rows.schema[k] for k in keys])
    types = [to_arrow_type(rows.schema[k].dataType) for k in keys]

    def build(batches):
        held: dict[tuple, Any] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for key, own in frame.groupby(keys, sort=False, dropna=False)["value_of_cell"]:
                key = key if isinstance(key, tuple) else (key,)
                new = statistic.state(own.to_numpy())
                held[key] = statistic.merge(held[key], new) if key in held else new
            if len(held) > HELD_CELLS:
                yield pack(held)
                held = {}
        yield pack(held)

    def pack(held):
        plain = [(*[None if k != k else k for k in key], pickle.dumps(state)) for key, state in held.items()]
        return _rows(plain, [*keys, "state"], [*types, pa.binary()])

    def merge(batches):
        key, state, done = None, None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(keys) + 1)]
            for *at, blob in zip(*columns, strict=True):
                new = pickle.loads(blob)
                if at == key:
                    state = statistic.merge(state, new)
                    continue
                if key is not None:
                    done.append((*key, bands(state)))
                key, state = at, new
            yield _rows(done, [*keys, "bands"], [*types, pa.list_(pa.float64())])
            done = []
        if key is not None:
            yield _rows([(*key, bands(state))], [*keys, "bands"], [*types, pa.list_(pa.float64())])

    def bands(state):
        result = statistic.finish(state)
        return [float(x) for x in result] if isinstance(result, (Sequence, np.ndarray)) else [None if result is None else float(result)]

    states = rows.mapInArrow(build, StructType([*fields, StructField("state", BinaryType())]))
    sorted_states = states.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_states.mapInArrow(merge, StructType([*fields, StructField("bands", ArrayType(DoubleType()))]))


def cell_statistic(cells: DataFrame, statistic: Statistic, value: str = "z", keys: list[str] | None = None) -> DataFrame:
    """One number per cell: the keys (tile_id, row and col by default) and v."""
    keys = keys or ["tile_id", "row", "col"]
    return statistic_per_cell(cells, keys, value, statistic).select(*keys, F.col("bands")[0].alias("v"))


def cell_bands(cells: DataFrame, statistic: Statistic, value: str = "z", keys: list[str] | None = None) -> DataFrame:
    """One row per cell and band: the keys, band (from 0) and v."""
    keys = keys or ["tile_id", "row", "col"]
    return statistic_per_cell(cells, keys, value, statistic).select(*keys, F.posexplode("bands").alias("band", "v"))
