"""Grids from ranges, constants, functions, arrays, pieces and tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridframe.functions import dtypes
from gridframe.grid import GridFrame
from gridframe.plans.index import axes, cells, ravel, unravel
from gridframe.plans.layout import GridLayout

LAYOUT_OPTIONS = ("n_blocks", "split", "halo", "periodic", "grid", "bounds")


def layout_for(shape, layout: GridLayout | None = None, **options) -> GridLayout:
    shape = (shape,) if isinstance(shape, (int, np.integer)) else tuple(shape)
    given = {k: v for k, v in options.items() if v is not None}
    if unknown := given.keys() - set(LAYOUT_OPTIONS):
        raise TypeError(f"unknown layout options: {sorted(unknown)}")
    if layout is not None:
        if given:
            raise ValueError("give a layout or its options, not both")
        if layout.shape != shape:
            raise ValueError(f"Shapes must match: {layout.shape} and {shape}")
        return layout
    return GridLayout(shape, **given)


def full(spark: SparkSession, shape, fill_value, dtype=None, dims=None, unit=None, **options) -> GridFrame:
    layout = layout_for(shape, **options)
    dtype = np.dtype(dtype) if dtype is not None else np.asarray(fill_value).dtype
    base = cells(spark, layout.shape) if layout.ndim else spark.range(1).select()
    return GridFrame(base, dtypes.cast(dtypes.literal(fill_value), np.asarray(fill_value).dtype, dtype), layout, dtype, dims, unit)


def zeros(spark: SparkSession, shape, dtype=float, **options) -> GridFrame:
    return full(spark, shape, np.zeros((), dtype).item(), dtype, **options)


def ones(spark: SparkSession, shape, dtype=float, **options) -> GridFrame:
    return full(spark, shape, np.ones((), dtype).item(), dtype, **options)


empty = zeros


def full_like(a: GridFrame, fill_value, dtype=None) -> GridFrame:
    dtype = np.dtype(dtype or a.dtype)
    return a.like(dtypes.cast(dtypes.literal(fill_value), np.asarray(fill_value).dtype, dtype), dtype)


def zeros_like(a: GridFrame, dtype=None) -> GridFrame:
    return full_like(a, 0, dtype)


def ones_like(a: GridFrame, dtype=None) -> GridFrame:
    return full_like(a, 1, dtype)


empty_like = zeros_like


def arange(spark: SparkSession, start, stop=None, step=1, dtype=None, dims=None, unit=None, **options) -> GridFrame:
    if stop is None:
        start, stop = 0, start
    if step == 0:
        raise ValueError("step can't be 0")
    n = max(0, math.ceil((stop - start) / step))
    dtype = np.dtype(dtype) if dtype is not None else np.result_type(start, stop, step)
    own = np.result_type(start, step)
    value = dtypes.cast(F.lit(start) + F.col("i0") * F.lit(step), np.result_type(own, np.int64), dtype)
    return GridFrame(cells(spark, (n,)), value, layout_for((n,), **options), dtype, dims, unit)


def linspace(spark: SparkSession, start, stop, num: int = 50, endpoint: bool = True, dtype=None, dims=None, unit=None, **options) -> GridFrame:
    if num < 0:
        raise ValueError("num can't be negative")
    dtype = np.dtype(dtype) if dtype is not None else np.result_type(start, stop, float)
    parts = num - 1 if endpoint else num
    step = (stop - start) / parts if parts > 0 else 0.0
    value = F.col("i0").cast("double") * F.lit(float(step)) + F.lit(float(start))
    if endpoint and num > 1:
        value = F.when(F.col("i0") == num - 1, F.lit(float(stop))).otherwise(value)
    return GridFrame(cells(spark, (num,)), dtypes.cast(value, float, dtype), layout_for((num,), **options), dtype, dims, unit)


def fromfunction(spark: SparkSession, function: Callable[..., Column], shape, dtype=float, dims=None, unit=None, **options) -> GridFrame:
    """A grid of a function of the index columns that gives a column."""
    layout = layout_for(shape, **options)
    return GridFrame(cells(spark, layout.shape), dtypes.cast(function(*map(F.col, axes(layout.ndim))), dtype, dtype), layout, dtype, dims, unit)


def fromfunction_numpy(spark: SparkSession, function: Callable, shape, dtype=None, dims=None, unit=None, **options) -> GridFrame:
    """A grid of a vectorised NumPy function of index arrays, run on the executors."""
    layout = layout_for(shape, **options)
    if dtype is None:
        dtype = np.asarray(function(*[np.zeros(1, np.int64)] * layout.ndim)).dtype
    dtype, names = np.dtype(dtype), axes(layout.ndim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.broadcast_to(np.asarray(function(*[batch.column(i).to_numpy() for i in names])), batch.num_rows).astype(dtype)
            yield pa.RecordBatch.from_arrays([*batch.columns, value_array(v)], names=[*names, "v"])

    rows = cells(spark, layout.shape).mapInArrow(run, ", ".join([*(f"{i} long" for i in names), f"v {dtypes.spark_type(dtype)}"]))
    return GridFrame(rows, F.col("v"), layout, dtype, dims, unit)


def value_array(v: np.ndarray) -> pa.Array:
    if v.dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(v.real.astype(float)), pa.array(v.imag.astype(float))], names=["re", "im"])
    if v.dtype == np.uint64:
        return pa.array(v).cast(pa.decimal128(20, 0))
    if v.dtype.kind in "iu":
        return pa.array(v.astype(np.int64))
    return pa.array(v.astype(np.float32) if v.dtype == np.float16 else v)


def array_frame(spark: SparkSession, data: np.ndarray) -> DataFrame:
    """The index columns and v of a NumPy array, which the driver holds."""
    data = np.asarray(data)
    where = np.unravel_index(np.arange(data.size), data.shape) if data.ndim else ()
    columns = [pa.array(np.asarray(w, np.int64)) for w in where]
    return spark.createDataFrame(pa.Table.from_arrays([*columns, value_array(data.reshape(-1))], names=[*axes(data.ndim), "v"]))


def array(spark: SparkSession, data, dtype=None, dims=None, unit=None, **options) -> GridFrame:
    """A grid of the driver's data; of a grid, the same with the layout options given."""
    if isinstance(data, GridFrame):
        given = {k: v for k, v in options.items() if v is not None}
        layout = given.pop("layout", None) or (GridLayout(data.shape, **({"halo": data.layout.halo, "periodic": data.layout.periodic, "n_blocks": data.layout.n_blocks, "split": data.layout.split} | given)) if given else data.layout)
        out = data.like(data.value, layout=layout, dims=dims or data.dims, unit=unit or data.unit)
        return out if dtype is None else out.astype(dtype)
    data = np.asarray(data, dtype)
    return GridFrame(array_frame(spark, data), F.col("v"), layout_for(data.shape, **options), data.dtype, dims, unit)


def asarray(spark: SparkSession, data, dtype=None, **options) -> GridFrame:
    if isinstance(data, GridFrame) and (dtype is None or np.dtype(dtype) == data.dtype) and not any(v is not None for v in options.values()):
        return data
    return array(spark, data, dtype, **options)


def from_table(df: DataFrame, index: Sequence[str | Column], value: str | Column, shape, dtype=None, dims=None, unit=None, **options) -> GridFrame:
    """A grid of a table whose index columns are dense and unique."""
    index = [F.col(i) if isinstance(i, str) else i for i in index]
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(index)], value.alias("v"))
    dtype = np.dtype(dtype) if dtype is not None else dtypes.numpy_type(rows.schema["v"].dataType.simpleString())
    return GridFrame(rows, F.col("v").cast(dtypes.spark_type(dtype)), layout_for(shape, **options), dtype, dims, unit)


def from_sums(df: DataFrame, index: Sequence[Column], value: Column, shape, dtype=float, dims=None, unit=None, **options) -> GridFrame:
    """A grid of sums of a table's values by cell; cells without rows are 0."""
    layout = layout_for(shape, **options)
    sums = df.select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(index)], value.alias("v")).groupBy(*axes(layout.ndim)).agg(F.sum("v").alias("v"))
    rows = cells(df.sparkSession, layout.shape).join(sums, axes(layout.ndim), "left")
    return GridFrame(rows, F.coalesce(F.col("v"), F.lit(0)).cast(dtypes.spark_type(dtype)), layout, dtype, dims, unit)


def from_local(pieces: DataFrame, piece: str, local: Sequence[str], value: str, shape_tail: Sequence[int], split: int = 0, dtype=None, **options) -> GridFrame:
    """A grid of pieces stacked along `split` in the order of `piece`.

    pieces has a row for each cell: the piece's number, its local indices and the
    value. Extents along the other axes (shape_tail) are shared. Lengths are counted
    by piece, their running sum is joined back, and one aggregate checks that each
    piece is whole."""
    local_columns = [F.col(c) for c in local]
    lengths = pieces.groupBy(F.col(piece).alias("__piece")).agg((F.max(local_columns[split]) + 1).alias("n"), F.count("*").alias("cells"), F.min(local_columns[split]).alias("low"))
    tail = math.prod(shape_tail)
    bad = lengths.where((F.col("cells") != F.col("n") * tail) | (F.col("low") < 0)).limit(1).collect()
    if bad:
        raise ValueError(f"piece {bad[0]['__piece']} has another shape than the rest")
    before = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    starts = lengths.select("__piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shape = [*shape_tail]
    shape.insert(split, int(total))
    rows = pieces.join(F.broadcast(starts), F.col(piece) == F.col("__piece"))
    index = [(c + F.col("start")) if k == split else c for k, c in enumerate(local_columns)]
    return from_table(rows, index, value, tuple(shape), dtype, **options)


def reshaped(a: GridFrame, shape: Sequence[int], **options) -> GridFrame:
    """The same cells in row-major order under another shape."""
    if math.prod(shape) != a.size:
        raise ValueError("a shape of another size")
    flat = ravel([F.col(i) for i in a.index], a.shape)
    rows = a.base.select(*unravel(flat, shape), a.value.alias("v"))
    return GridFrame(rows, F.col("v"), layout_for(shape, **options), a.dtype, None, a.unit)
