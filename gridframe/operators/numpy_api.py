"""NumPy's functions for grids: what np.sum(grid), np.clip(grid, ...) and others do."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridframe.functions import dtypes, npmath
from gridframe.functions.units import planned
from gridframe.grid import Aligned, GridFrame, elementwise
from gridframe.operators import combine, reduce, scan


def where(condition, x=None, y=None) -> GridFrame:
    if x is None or y is None:
        raise TypeError("where needs a condition and two values")
    both = Aligned([condition, x, y])
    unit, factors = planned("where", both.units[1:])
    kind = np.result_type(*both.types[1:])
    mask = dtypes.cast(both.columns[0], both.types[0].dtype if isinstance(both.types[0], np.ndarray) else np.asarray(both.types[0]).dtype, bool)
    values = []
    for c, t, f in zip(both.columns[1:], both.types[1:], factors):
        own = t.dtype if isinstance(t, np.ndarray) else np.asarray(t).dtype
        values.append(dtypes.cast(c, own, kind) if f == 1.0 else c.cast("double") * F.lit(f))
    return GridFrame(both.base, F.when(mask, values[0]).otherwise(values[1]), both.layout, kind, both.dims, unit)


def clip(a: GridFrame, a_min=None, a_max=None, *, min=None, max=None) -> GridFrame:
    low, high = (a_min if min is None else min), (a_max if max is None else max)
    out = a
    if low is not None:
        out = elementwise("maximum", out, low)
    if high is not None:
        out = elementwise("minimum", out, high)
    return out


def around(a: GridFrame, decimals: int = 0) -> GridFrame:
    if a.dtype.kind in "iub":
        return a
    if a.dtype.kind == "c":
        return a.like(dtypes.make_complex(npmath.round_(a.value["re"], decimals), npmath.round_(a.value["im"], decimals)))
    return a.like(npmath.round_(a.value, decimals).cast(dtypes.spark_type(a.dtype)))


def real(a: GridFrame) -> GridFrame:
    return a.like(a.value["re"], dtype=float) if a.dtype.kind == "c" else a


def imag(a: GridFrame) -> GridFrame:
    return a.like(a.value["im"], dtype=float) if a.dtype.kind == "c" else a.like(dtypes.cast(F.lit(0), int, a.dtype))


def angle(a: GridFrame, deg: bool = False) -> GridFrame:
    re, im = dtypes.complex_parts(a.value, a.dtype)
    value = F.atan2(im, re)
    return a.like(F.degrees(value) if deg else value, dtype=float, unit=None)


def linalg_norm(x: GridFrame, ord=None):
    if x.ndim != 1 and ord not in (None, "fro"):
        raise ValueError("only the Frobenius norm is defined for arrays of several axes")
    return reduce.norm(x, 2 if ord is None else ord)


def _method(f):
    return lambda a, *args, **kwargs: f(a, *args, **{k: v for k, v in kwargs.items() if v is not np._NoValue})


FUNCTIONS = {
    np.where: where, np.clip: clip, np.round: around, np.around: around, np.real: real, np.imag: imag, np.angle: angle,
    np.isclose: reduce.isclose, np.allclose: reduce.allclose, np.array_equal: reduce.array_equal,
    np.sum: _method(reduce.sum), np.prod: _method(reduce.prod), np.min: _method(reduce.min), np.max: _method(reduce.max), np.amin: _method(reduce.min), np.amax: _method(reduce.max),
    np.mean: _method(reduce.mean), np.var: _method(reduce.var), np.std: _method(reduce.std), np.all: _method(reduce.all), np.any: _method(reduce.any),
    np.argmin: _method(reduce.argmin), np.argmax: _method(reduce.argmax), np.vdot: reduce.vdot, np.dot: reduce.dot, np.linalg.norm: linalg_norm,
    np.cumsum: _method(scan.cumsum), np.cumprod: _method(scan.cumprod), np.concatenate: combine.concatenate, np.stack: combine.stack,
    np.shape: lambda a: a.shape, np.ndim: lambda a: a.ndim, np.size: lambda a: a.size, np.copy: lambda a, **_: a.copy(),
}
