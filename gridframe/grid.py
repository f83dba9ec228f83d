"""GridFrame: a dense n-dimensional array as a DataFrame keyed by its indices.

A grid holds a DataFrame with the index columns i0, i1, ... and a value
expression over it. Elementwise operations on grids of one DataFrame only combine
expressions, so a chain of them is one projection; grids of different DataFrames
are joined on the index, and operands of fewer axes on the axes they have. Methods
run a job only where they bring values to the driver or need a shape that the values
decide, as selections by a mask do.

Frames are dense and unique in the index, and hold no NULL (NaN marks what is
missing); constructors guarantee it and validate() checks it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions import dtypes, npmath
from gridframe.functions import units as physical
from gridframe.plans.index import axes
from gridframe.plans.layout import GridLayout

#: Operands of at most so many cells may be broadcast in joins.
BROADCAST_CELLS = 1_000_000


def hinted(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_CELLS else df


class GridFrame:
    __array_priority__ = 1000
    __hash__ = None

    def __init__(self, base: DataFrame, value: Column, layout: GridLayout, dtype, dims: Sequence[str] | None = None, unit=None):
        self.base, self.value, self.layout, self.dtype = base, value, layout, np.dtype(dtype)
        if dims is not None and (len(dims) != layout.ndim or len(set(dims)) != len(dims)):
            raise ValueError("dims need one name for each axis")
        self.dims, self.unit = None if dims is None else tuple(dims), physical.unit(unit)

    # What it is

    @property
    def shape(self) -> tuple[int, ...]:
        return self.layout.shape

    @property
    def ndim(self) -> int:
        return self.layout.ndim

    @property
    def size(self) -> int:
        return self.layout.size

    @property
    def itemsize(self) -> int:
        return self.dtype.itemsize

    @property
    def nbytes(self) -> int:
        return self.size * self.itemsize

    @property
    def index(self) -> list[str]:
        return axes(self.ndim)

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    @property
    def df(self) -> DataFrame:
        """The index columns and v."""
        return self.base.select(*self.index, self.value.alias("v"))

    def __len__(self) -> int:
        if not self.ndim:
            raise TypeError("len() of an array without axes")
        return self.shape[0]

    def __repr__(self) -> str:
        extra = "".join(f", {k}={v}" for k, v in (("dims", self.dims), ("unit", self.unit)) if v is not None)
        return f"GridFrame(shape={self.shape}, dtype={self.dtype}, grid={self.layout.grid}{extra})"

    def like(self, value: Column, dtype=None, base: DataFrame | None = None, layout: GridLayout | None = None, unit="same", dims="same") -> GridFrame:
        """A grid of this one's kind with another value."""
        return GridFrame(base if base is not None else self.base, value, layout or self.layout, dtype or self.dtype, self.dims if isinstance(dims, str) else dims, self.unit if isinstance(unit, str) and unit == "same" else unit)

    def materialised(self) -> GridFrame:
        """This grid over a frame of its own, computed once and kept in the shared
        checkpoint folder: cuts the lineage of iterations."""
        sc = self.spark.sparkContext
        if not sc.getCheckpointDir():
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridframe-checkpoints-"))
        return self.like(F.col("v"), base=self.df.checkpoint(eager=True))

    def validate(self) -> GridFrame:
        """Raise unless the frame is dense, unique and without NULL."""
        inside = F.lit(True)
        for i, n in zip(self.index, self.shape):
            inside = inside & F.col(i).between(0, n - 1)
        counts = self.df.groupBy(*self.index).agg(F.count("*").alias("n"), F.count("v").alias("values")) if self.ndim else self.df.agg(F.count("*").alias("n"), F.count("v").alias("values"))
        bad = counts.where(~inside | (F.col("n") != 1) | (F.col("values") != 1)) if self.ndim else counts.where("n <> 1 or values <> 1")
        if not bad.isEmpty() or counts.count() != self.size:
            raise ValueError("the frame is no dense array")
        return self

    def labeled(self, *dims: str) -> GridFrame:
        return self.like(self.value, dims=dims or None)

    def set_units(self, unit) -> GridFrame:
        return self.like(self.value, unit=unit)

    def to_units(self, unit) -> GridFrame:
        """Converted to another unit of the same dimension."""
        new = physical.unit(unit)
        factor = (self.unit or physical.DIMENSIONLESS).factor_to(new)
        return self.like(self.value.cast("double") * F.lit(factor), dtype=np.result_type(self.dtype, float), unit=new)

    def astype(self, dtype) -> GridFrame:
        return self.like(dtypes.cast(self.value, self.dtype, dtype), dtype=dtype)

    def copy(self) -> GridFrame:
        return self.like(self.value)

    # To the driver

    def to_numpy(self) -> np.ndarray:
        """The whole array, on the driver."""
        rows = self.df.toArrow()
        if rows.num_rows != self.size:
            raise ValueError(f"the frame has {rows.num_rows} rows for {self.size} cells")
        out = np.empty(self.shape, self.dtype)
        values = dtypes.from_arrow(rows.column("v").combine_chunks(), self.dtype)
        out[tuple(rows.column(i).to_numpy() for i in self.index)] = values if self.ndim else values[0]
        return out

    def gather(self, root: int | None = None) -> np.ndarray:
        """The whole array: on the driver, which stands for every root."""
        return self.to_numpy()

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        if copy is False:
            raise ValueError("gathering an array makes a copy")
        return self.to_numpy().astype(dtype or self.dtype)

    def get(self, *index: int):
        """One value, on the driver."""
        index = tuple(index[0]) if len(index) == 1 and isinstance(index[0], (tuple, list)) else index
        self.layout.owner(index)
        rows = self.df
        for i, k, n in zip(self.index, index, self.shape):
            rows = rows.where(F.col(i) == int(k) % n)
        v = rows.select("v").first()["v"]
        return self.dtype.type(complex(v["re"], v["im"]) if self.dtype.kind == "c" else v)

    def item(self):
        if self.size != 1:
            raise ValueError("only an array of one element is a scalar")
        return self.get(*(0,) * self.ndim)

    def __iter__(self):
        return iter(self.to_numpy())

    def __bool__(self) -> bool:
        if self.size != 1:
            raise ValueError("the truth of an array of more or less than one element is ambiguous")
        return bool(self.item())

    def __float__(self) -> float:
        return float(self.item())

    def __int__(self) -> int:
        return int(self.item())

    def to_labelled(self) -> DataFrame:
        """A DataFrame with the dims as column names."""
        if self.dims is None:
            raise ValueError("labelled export needs dims")
        return self.df.select(*[F.col(i).alias(d) for i, d in zip(self.index, self.dims)], "v")

    def to_xarray(self, name: str | None = None, attrs: dict | None = None):
        """A labelled xarray.DataArray, where xarray is installed."""
        import xarray

        if self.dims is None:
            raise ValueError("labelled export needs dims")
        attrs = dict(attrs or {})
        if self.unit is not None:
            attrs.setdefault("units", str(self.unit))
        return xarray.DataArray(self.to_numpy(), dims=self.dims, name=name, attrs=attrs)

    # Elementwise

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, where=True, dtype=None, **kwargs):
        if method != "__call__" or kwargs:
            return NotImplemented
        if ufunc is np.matmul:
            return self._reductions().dot(*inputs)
        result = elementwise(ufunc.__name__, *inputs, where=where, out=out[0] if isinstance(out, tuple) else out)
        return result.astype(dtype) if dtype is not None else result

    def __array_function__(self, func, types, args, kwargs):
        from gridframe.operators.numpy_api import FUNCTIONS

        if func not in FUNCTIONS:
            raise TypeError(f"{func.__name__} is not defined for grids")
        return FUNCTIONS[func](*args, **kwargs)

    @staticmethod
    def _reductions():
        from gridframe.operators import reduce

        return reduce

    def __getitem__(self, key):
        from gridframe.operators.select import take

        return take(self, key)

    def assign(self, key, value) -> GridFrame:
        """This grid with the selected cells set: a new grid."""
        from gridframe.operators.select import assign

        return assign(self, key, value)

    def redistribute(self, layout: GridLayout) -> GridFrame:
        from gridframe.operators.placement import redistribute

        return redistribute(self, layout)

    def rebalance(self, weights: GridFrame) -> GridFrame:
        from gridframe.operators.placement import rebalance

        return rebalance(self, weights)

    def cumsum(self, axis: int | None = None, dtype=None) -> GridFrame:
        from gridframe.operators.scan import cumsum

        return cumsum(self, axis, dtype)

    def cumprod(self, axis: int | None = None, dtype=None) -> GridFrame:
        from gridframe.operators.scan import cumprod

        return cumprod(self, axis, dtype)


def _operator(name: str, reflected: bool = False) -> Callable:
    def method(self, other):
        return elementwise(name, other, self) if reflected else elementwise(name, self, other)

    return method


for _dunder, _name in {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "floor_divide", "pow": "power"}.items():
    setattr(GridFrame, f"__{_dunder}__", _operator(_name))
    setattr(GridFrame, f"__r{_dunder}__", _operator(_name, True))
for _dunder, _name in {"lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal", "eq": "equal", "ne": "not_equal"}.items():
    setattr(GridFrame, f"__{_dunder}__", _operator(_name))
for _dunder, _name in {"neg": "negative", "pos": "positive", "abs": "absolute"}.items():
    setattr(GridFrame, f"__{_dunder}__", (lambda n: lambda self: elementwise(n, self))(_name))
for _name in "sum prod min max mean var std all any argmin argmax vdot dot norm".split():
    setattr(GridFrame, _name, (lambda n: lambda self, *a, **k: getattr(GridFrame._reductions(), n)(self, *a, **k))(_name))


class Aligned:
    """Operands brought onto one frame: their value columns, and what they share."""

    def __init__(self, operands: Sequence[Any]):
        grids = [x for x in operands if isinstance(x, GridFrame)]
        first = max(grids, key=lambda g: (g.ndim, g.size))
        self.layout, self.dims = first.layout, first.dims
        for g in grids:
            if g.shape == first.shape and g.layout != first.layout:
                raise ValueError("Layouts must match")
        base, self.columns, self.types, self.units = first.base, [], [], []
        joined: dict[int, str] = {id(first.base): ""}
        renamed = False
        for n, x in enumerate(operands):
            if isinstance(x, GridFrame) and x.shape == first.shape and id(x.base) in joined and not joined[id(x.base)]:
                self.columns.append(None)
                continue
            self.columns.append(x)
        # Values over the first frame are computed before any join, under names of their own.
        others = [(n, x) for n, x in enumerate(self.columns) if x is not None and not np.isscalar(x) and not isinstance(x, (bool, complex)) and not (isinstance(x, np.ndarray) and x.ndim == 0)]
        if others:
            own = {n: operands[n].value.alias(f"__{n}") for n, x in enumerate(self.columns) if x is None}
            base = base.select(*axes(first.ndim), *own.values())
            renamed = True
            for n, x in others:
                base = self._join(base, n, x, first)
        for n, x in enumerate(operands):
            if isinstance(x, GridFrame):
                self.columns[n] = F.col(f"__{n}") if renamed else x.value
                self.types.append(np.empty(0, x.dtype))
                self.units.append(x.unit)
            elif isinstance(x, np.ndarray) and x.ndim:
                self.columns[n] = F.col(f"__{n}")
                self.types.append(np.empty(0, x.dtype))
                self.units.append(None)
            else:
                x = x.item() if isinstance(x, np.ndarray) else x
                self.columns[n] = dtypes.literal(x)
                self.types.append(x)
                self.units.append(None)
        self.base = base

    @staticmethod
    def _join(base: DataFrame, n: int, x, first: GridFrame) -> DataFrame:
        shape = x.shape
        if len(shape) > first.ndim or any(a not in (1, b) for a, b in zip(shape[::-1], first.shape[::-1])):
            raise ValueError(f"Shapes must match: {shape} and {first.shape}")
        offset = first.ndim - len(shape)
        own = [k for k, m in enumerate(shape) if m != 1 or first.shape[k + offset] == 1]
        if isinstance(x, np.ndarray):
            from gridframe.sources.create import array_frame

            rows, size = array_frame(first.spark, x), x.size
            value = F.col("v")
        else:
            rows, size, value = x.base, x.size, x.value
        rows = rows.select(*[F.col(f"i{k}").alias(f"i{k + offset}") for k in own], value.alias(f"__{n}"))
        on = [f"i{k + offset}" for k in own]
        return base.join(hinted(rows, size), on) if on else base.crossJoin(F.broadcast(rows.limit(1)))


def elementwise(name: str, *operands, where=True, out: GridFrame | None = None) -> GridFrame:
    """A NumPy function of that name on grids, arrays and numbers."""
    name = npmath.ALIASES.get(name, name)
    operands = tuple(np.asarray(x) if isinstance(x, (list, tuple)) else x for x in operands)
    if not all(isinstance(x, (GridFrame, np.ndarray, np.generic, int, float, complex, bool)) for x in operands):
        return NotImplemented
    extra = [where] if where is not True else []
    if extra and out is None:
        raise ValueError("where= needs out=")
    aligned = Aligned([*operands, *extra, *([out] if out is not None else [])])
    n = len(operands)
    exponent = operands[1] if name in ("power", "float_power") and np.isscalar(operands[1]) and not isinstance(operands[1], complex) else None
    unit, factors = physical.planned(name, aligned.units[:n], exponent)
    columns = [c if f == 1.0 else c.cast("double") * F.lit(f) for c, f in zip(aligned.columns, factors)]
    types = [t if f == 1.0 else np.empty(0, float) for t, f in zip(aligned.types, factors)]
    value, dtype = evaluated(name, columns, types, operands)
    if isinstance(value, tuple):
        return tuple(GridFrame(aligned.base, v, aligned.layout, d, aligned.dims, unit) for v, d in zip(value, dtype))
    if out is not None:
        value = dtypes.cast(value, dtype, out.dtype)
        if extra:
            mask = aligned.columns[n]
            value = F.when(mask, value).otherwise(aligned.columns[-1])
        dtype = out.dtype
    return GridFrame(aligned.base, value, aligned.layout, dtype, aligned.dims, unit)


def evaluated(name: str, columns: list[Column], types: list, operands: Sequence = ()) -> tuple:
    """The value of a function of columns of NumPy types, and its type."""
    if name == "divmod":
        parts = [evaluated(n, columns, types, operands) for n in ("floor_divide", "mod")]
        return tuple(p[0] for p in parts), tuple(p[1] for p in parts)
    ufunc = getattr(np, name, None)
    if not isinstance(ufunc, np.ufunc):
        raise TypeError(f"{name} is not defined for grids")
    with np.errstate(all="ignore"):
        dtype = ufunc(*[t if isinstance(t, np.ndarray) else np.asarray(t)[None] if isinstance(t, np.generic) else t for t in types]).dtype
        common = np.result_type(*types)
    if common.kind == "c":
        return complex_value(name, columns, types), dtype
    whole, boolean = common.kind in "iu", common.kind == "b"
    if name == "conjugate":
        return columns[0], dtype
    if name in npmath.UNARY:
        f, kind = npmath.UNARY[name]
    elif name in npmath.BINARY:
        f, kind = npmath.BINARY[name]
    else:
        raise TypeError(f"{name} is not defined for grids")
    if boolean and name in ("add", "multiply", "maximum", "minimum", "fmax", "fmin"):
        f, kind = (npmath.logical_or if name in ("add", "maximum", "fmax") else npmath.logical_and), "bool"
    elif name in ("invert", "bitwise_and", "bitwise_or", "bitwise_xor"):
        return f(*columns, boolean), dtype
    elif name in ("floor_divide", "mod", "fmod", "reciprocal") and whole:
        return dtypes.wrapped(f(*columns, True), dtype), dtype
    elif name == "power" and whole:
        n = operands[1] if len(operands) > 1 else None
        exact = isinstance(n, (int, np.integer)) and not isinstance(n, bool)
        return dtypes.wrapped(npmath.int_power(columns[0], int(n)) if exact else npmath.power(*columns, True), dtype), dtype
    elif name in ("fmax", "fmin") and whole:
        f = npmath.maximum if name == "fmax" else npmath.minimum
    elif kind == "whole" and dtype.kind in "iub":
        return (npmath.sign(columns[0]).cast("long") if name == "sign" else columns[0]), dtype
    if boolean:
        columns = [c.cast("int") for c in columns]
    if dtype.kind == "f" and common.kind in "fiu" and kind == "same":
        columns = [npmath.dbl(c) for c in columns]
    value = f(*columns)
    if dtype.kind in "iu":
        value = dtypes.wrapped(value, dtype)
    return (value.cast(dtypes.spark_type(dtype)) if dtype.kind in "fiu" else value), dtype


def complex_value(name: str, columns: list[Column], types: list) -> Column:
    """Functions of complex numbers, as pairs of doubles."""
    kinds = [t.dtype if isinstance(t, np.ndarray) else np.asarray(t).dtype for t in types]
    (a, b), *rest = [dtypes.complex_parts(c, k) for c, k in zip(columns, kinds)]
    c, d = rest[0] if rest else (None, None)
    make = dtypes.make_complex
    if name in ("add", "subtract"):
        return make(a + c, b + d) if name == "add" else make(a - c, b - d)
    if name == "multiply":
        return make(a * c - b * d, a * d + b * c)
    if name == "divide":
        n = c * c + d * d
        return make(npmath.divide(a * c + b * d, n), npmath.divide(b * c - a * d, n))
    if name in ("equal", "not_equal"):
        same = npmath.equal(a, c) & npmath.equal(b, d)
        return same if name == "equal" else ~same
    one = {
        "negative": lambda: make(-a, -b), "positive": lambda: make(a, b), "conjugate": lambda: make(a, -b), "absolute": lambda: F.hypot(a, b), "square": lambda: make(a * a - b * b, 2 * a * b),
        "exp": lambda: make(F.exp(a) * F.cos(b), F.exp(a) * F.sin(b)), "isnan": lambda: F.isnan(a) | F.isnan(b), "isfinite": lambda: npmath.isfinite(a) & npmath.isfinite(b), "isinf": lambda: npmath.isinf(a) | npmath.isinf(b),
    }
    if name in one:
        return one[name]()
    raise TypeError(f"{name} is not defined for complex grids")
