"""Running sums and products, of any type that NumPy accumulates.

Lines of up to SPAN cells are sorted and accumulated where one exchange brings them
together. Longer lines are cut into spans: spans are reduced first, in parts before
anything is shuffled, the totals before each span come from a pass over these few
rows, and each span starts from its total. So no task holds a whole line, and only
associativity is asked of the operation: complex numbers and 64-bit integers that
wrap around give what NumPy gives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.functions import dtypes
from gridframe.functions.units import UnitError
from gridframe.grid import GridFrame
from gridframe.operators.reduce import combined, sum_type
from gridframe.profiling import watched

SPAN = 65_536


def runs(columns: Sequence[np.ndarray], n: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches in which all columns stay the same."""
    changes = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        changes |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def accumulated(rows: DataFrame, keys: list[str], index: list[str], ufunc: np.ufunc, dtype: np.dtype, exclusive: bool = False) -> DataFrame:
    """index and v of rows(keys..., index..., __carry, v), which are sorted by keys: the
    running values within equal keys. Carries start a line and aren't returned.
    exclusive: each row gets what is before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridframe.sources.create import value_array

        line, before = None, None
        with np.errstate(all="ignore"):
            for batch in batches:
                columns = [batch.column(k).to_numpy() for k in keys]
                carry, v = batch.column("__carry").to_numpy(zero_copy_only=False), dtypes.from_arrow(batch.column("v"), dtype)
                out = np.empty(len(v), dtype)
                for a, b in runs(columns, len(v)):
                    own = tuple(c[a].item() for c in columns)
                    if own != line:
                        line, before = own, None
                    made = ufunc.accumulate(v[a:b], dtype=dtype)
                    if before is not None:
                        made = ufunc(before, made)
                    if exclusive:
                        out[a:b] = np.r_[ufunc.identity if before is None else before, made[:-1]]
                    else:
                        out[a:b] = made
                    before = made[-1]
                kept = pa.array(~carry)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(kept) for i in index], value_array(out[~carry])], names=[*index, "v"])

    schema = ", ".join([*(f"{i} long" for i in index), f"v {dtypes.spark_type(dtype)}"])
    return rows.mapInArrow(run, schema)


def scanned(a: GridFrame, axis: int | None, dtype, ufunc: np.ufunc) -> GridFrame:
    if a.unit is not None:
        raise UnitError("running totals are not defined for units")
    if axis is None:
        if a.ndim != 1:
            raise TypeError("running totals of several axes need an axis")
        axis = 0
    if not -a.ndim <= axis < a.ndim:
        raise np.exceptions.AxisError(axis, a.ndim)
    axis %= a.ndim
    dtype = np.dtype(dtype or sum_type(a.dtype))
    along, others = f"i{axis}", [f"i{k}" for k in range(a.ndim) if k != axis]
    rows = watched(a.base, "scan").select(*a.index, F.lit(False).alias("__carry"), dtypes.cast(a.value, a.dtype, dtype).alias("v"))
    if a.shape[axis] <= SPAN:
        dealt = rows.repartition(*others) if others else rows.repartition(1)
        out = accumulated(dealt.sortWithinPartitions(*others, along), others, a.index, ufunc, dtype)
    else:
        keys = [*others, "__span"]
        rows = rows.withColumn("__span", F.call_function("div", F.col(along), F.lit(SPAN)).cast("long"))
        totals = combined(rows.select(*keys, "v"), keys, ufunc, dtype).withColumn("__carry", F.lit(False))
        spans = totals.repartition(*others) if others else totals.repartition(1)  # a row for every SPAN cells
        carries = accumulated(spans.sortWithinPartitions(*keys), others, keys, ufunc, dtype, exclusive=True)
        carries = carries.select(*[k if k != "__span" else F.col(k) for k in keys], F.lit(-1).cast("long").alias(along), F.lit(True).alias("__carry"), "v")
        dealt = rows.unionByName(carries).repartition(*keys).sortWithinPartitions(*keys, along)
        out = accumulated(dealt, keys, a.index, ufunc, dtype)
    return GridFrame(out, F.col("v"), a.layout, dtype, a.dims)


def cumsum(a: GridFrame, axis: int | None = None, dtype=None) -> GridFrame:
    return scanned(a, axis, dtype, np.add)


def cumprod(a: GridFrame, axis: int | None = None, dtype=None) -> GridFrame:
    return scanned(a, axis, dtype, np.multiply)
