"""Concatenation and stacking: unions of shifted frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from gridframe.functions import dtypes
from gridframe.functions.units import DIMENSIONLESS
from gridframe.grid import GridFrame
from gridframe.plans.layout import GridLayout


def alike(arrays: Sequence[GridFrame]):
    """The arrays' common type, and their values in the first one's unit."""
    if not arrays:
        raise ValueError("need at least one array")
    dtype = np.result_type(*[a.dtype for a in arrays])
    first = arrays[0].unit
    values = []
    for a in arrays:
        factor = 1.0 if a.unit is None and first is None else (a.unit or DIMENSIONLESS).factor_to(first or DIMENSIONLESS)
        values.append(dtypes.cast(a.value, a.dtype, dtype) if factor == 1.0 else a.value.cast("double") * F.lit(factor))
    return dtype, values


def concatenate(arrays: Sequence[GridFrame], axis: int = 0, strict: bool = False) -> GridFrame:
    """Arrays one after another along an axis. strict: only along an axis that isn't cut."""
    arrays = list(arrays)
    dtype, values = alike(arrays)
    a = arrays[0]
    if not -a.ndim <= axis < a.ndim:
        raise np.exceptions.AxisError(axis, a.ndim)
    axis %= a.ndim
    for b in arrays[1:]:
        if b.ndim != a.ndim or any(m != n for k, (m, n) in enumerate(zip(a.shape, b.shape)) if k != axis):
            raise ValueError("Shapes must match but along the axis")
        if any(m != n for k, (m, n) in enumerate(zip(a.layout.bounds, b.layout.bounds)) if k != axis):
            raise ValueError("Layouts must match but along the axis")
    if strict and a.layout.grid[axis] > 1:
        raise ValueError("the axis is cut into blocks")
    frames, start = [], 0
    for b, v in zip(arrays, values):
        frames.append(b.base.select(*[(F.col(i) + F.lit(start) if k == axis else F.col(i)).alias(i) for k, i in enumerate(b.index)], v.alias("v")))
        start += b.shape[axis]
    shape = tuple(start if k == axis else n for k, n in enumerate(a.shape))
    layout = GridLayout(shape, grid=a.layout.grid, halo=a.layout.halo, periodic=a.layout.periodic)
    return GridFrame(reduce(lambda x, y: x.unionByName(y), frames), F.col("v"), layout, dtype, a.dims, a.unit)


def stack(arrays: Sequence[GridFrame], axis: int = 0) -> GridFrame:
    """Arrays of one layout along a new axis."""
    arrays = list(arrays)
    dtype, values = alike(arrays)
    a = arrays[0]
    if any(b.shape != a.shape for b in arrays):
        raise ValueError("all input arrays must have the same shape")
    if any(b.layout != a.layout for b in arrays):
        raise ValueError("Layouts must match")
    if not -a.ndim - 1 <= axis <= a.ndim:
        raise np.exceptions.AxisError(axis, a.ndim + 1)
    axis %= a.ndim + 1
    frames = []
    for n, (b, v) in enumerate(zip(arrays, values)):
        old = [F.col(i) for i in b.index]
        new = [*old[:axis], F.lit(n).cast("long"), *old[axis:]]
        frames.append(b.base.select(*[c.alias(f"i{k}") for k, c in enumerate(new)], v.alias("v")))

    def put(values: tuple, x) -> tuple:
        return (*values[:axis], x, *values[axis:])

    layout = GridLayout(put(a.shape, len(arrays)), bounds=put(a.layout.bounds, (0, len(arrays))), halo=put(a.layout.halo, 0), periodic=put(a.layout.periodic, False))
    return GridFrame(reduce(lambda x, y: x.unionByName(y), frames), F.col("v"), layout, dtype, None, a.unit)
