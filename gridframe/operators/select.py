"""Selections and assignments: filters on the index, and re-indexing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.functions import dtypes
from gridframe.functions.units import DIMENSIONLESS
from gridframe.grid import GridFrame, hinted
from gridframe.plans.index import ravel
from gridframe.plans.layout import GridLayout
from gridframe.profiling import watched

Basic = list[int | range]


def basic_index(key, shape: Sequence[int]) -> Basic | None:
    """An int or range for each axis, or None if the key isn't basic."""
    key = key if isinstance(key, tuple) else (key,)
    if not all(k is Ellipsis or isinstance(k, (int, np.integer, slice)) and not isinstance(k, bool) for k in key):
        return None
    if sum(k is Ellipsis for k in key) > 1:
        raise IndexError("an index can have one ellipsis only")
    given = len(key) - (Ellipsis in key)
    if given > len(shape):
        raise IndexError(f"too many indices: {given} for {len(shape)} axes")
    at = key.index(Ellipsis) if Ellipsis in key else len(key)
    full = [*key[:at], *[slice(None)] * (len(shape) - given), *key[at + (Ellipsis in key) :]]
    out: Basic = []
    for k, n in zip(full, shape):
        if isinstance(k, slice):
            out.append(range(n)[k])
        else:
            if not -n <= k < n:
                raise IndexError(f"index {k} is out of bounds for {n} cells")
            out.append(int(k) % n)
    return out


def within(i: Column, part: int | range) -> Column:
    """Whether an index is selected."""
    if isinstance(part, int):
        return i == part
    if len(part) == 0:
        return F.lit(False)
    low, high, step = min(part[0], part[-1]), max(part[0], part[-1]), abs(part.step)
    inside = i.between(low, high)
    return inside if step == 1 else inside & ((i - F.lit(low)) % F.lit(step) == 0)


def place_in(i: Column, part: range) -> Column:
    """Where a selected index stands in its range."""
    return F.call_function("div", i - F.lit(part.start), F.lit(part.step)).cast("long")


def take(a: GridFrame, key):
    basic = basic_index(key, a.shape)
    if basic is None:
        return take_advanced(a, key)
    if all(isinstance(p, int) for p in basic):
        return a.get(*basic)
    condition = F.lit(True)
    for i, p, n in zip(a.index, basic, a.shape):
        if p != range(n):
            condition = condition & within(F.col(i), p)
    kept = [(k, p) for k, p in enumerate(basic) if not isinstance(p, int)]
    rows = watched(a.base.where(condition), "select").select(*[place_in(F.col(f"i{k}"), p).alias(f"i{n}") for n, (k, p) in enumerate(kept)], a.value.alias("v"))
    shape = tuple(len(p) for _, p in kept)
    return GridFrame(rows, F.col("v"), selected_layout(a.layout, kept, shape), a.dtype, tuple(a.dims[k] for k, _ in kept) if a.dims else None, a.unit)


def selected_layout(layout: GridLayout, kept, shape: tuple[int, ...]) -> GridLayout:
    """As many parts along each kept axis as before, as far as its cells allow."""
    grid = tuple(max(1, min(layout.grid[k], n)) for (k, _), n in zip(kept, shape))
    return GridLayout(shape, grid=grid if math.prod(shape) else None)


#: Places of which one window task numbers the rows.
SPAN_BITS = 16


def totals_before(counts: DataFrame, spans: int) -> DataFrame:
    """__span and __before, the sum of n over smaller spans, of counts(__span, n): within
    stretches of 2^SPAN_BITS spans by a window, of stretches in the same way."""
    if spans <= 1 << SPAN_BITS:
        before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("__span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    counts = counts.withColumn("__stretch", F.shiftright("__span", SPAN_BITS))
    longer = counts.groupBy(F.col("__stretch").alias("__span")).agg(F.sum("n").alias("n"))
    longer = totals_before(longer, -(-spans >> SPAN_BITS)).select(F.col("__span").alias("__stretch"), F.col("__before").alias("__rest"))
    before = Window.partitionBy("__stretch").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(longer, "__stretch")
    return counts.select("__span", (F.col("__before") + F.col("__rest")).alias("__before"))


def numbered(rows: DataFrame, flat: Column, size: int) -> DataFrame:
    """rows with __at, their place in the order of `flat`: places within spans of
    2^SPAN_BITS cells, and counted spans before."""
    rows = rows.withColumn("__flat", flat).withColumn("__span", F.shiftright("__flat", SPAN_BITS))
    spans = (size >> SPAN_BITS) + 1
    offsets = totals_before(rows.groupBy("__span").agg(F.count("*").alias("n")), spans)
    inside = Window.partitionBy("__span").orderBy("__flat")
    return rows.withColumn("__row", F.row_number().over(inside)).join(hinted(offsets, spans), "__span").withColumn("__at", F.col("__before") + F.col("__row") - 1)


def take_advanced(a: GridFrame, key) -> GridFrame:
    """A mask over all axes, or a list of places along the first."""
    if isinstance(key, GridFrame) and key.dtype == bool:
        if key.shape != a.shape:
            raise IndexError("a mask needs the array's shape")
        from gridframe.grid import Aligned

        both = Aligned([a, key])
        chosen = both.base.where(both.columns[1])
        n = chosen.count()  # the shape of the result
        rows = numbered(chosen.select(*a.index, both.columns[0].alias("v")), ravel([F.col(i) for i in a.index], a.shape), a.size).select(F.col("__at").alias("i0"), "v")
        return GridFrame(rows, F.col("v"), GridLayout((n,), grid=(max(1, min(a.layout.n_blocks, n)),) if n else None), a.dtype, None, a.unit)
    key = key if isinstance(key, tuple) else (key,)
    arrays = [np.asarray(k) for k in key]
    if len(arrays) == 1 and arrays[0].dtype == bool:
        from gridframe.sources.create import array

        return take_advanced(a, array(a.spark, arrays[0]) if arrays[0].shape == a.shape else None)
    if any(x.dtype.kind not in "iu" or x.ndim > 1 for x in arrays) or len(arrays) > a.ndim:
        raise IndexError("only integers, slices, an ellipsis, masks and lists of integers are indices")
    places = np.broadcast_arrays(*arrays)
    for x, n in zip(places, a.shape):
        if ((x < -n) | (x >= n)).any():
            raise IndexError("an index is out of bounds")
    import pyarrow as pa

    wanted = pa.Table.from_arrays([pa.array(np.arange(len(places[0])))] + [pa.array(x.astype(np.int64) % n) for x, n in zip(places, a.shape)], names=["__at", *[f"i{k}" for k in range(len(places))]])
    wanted = a.spark.createDataFrame(wanted)
    rest = list(range(len(places), a.ndim))
    rows = a.df.join(hinted(wanted, len(places[0])), [f"i{k}" for k in range(len(places))])
    rows = rows.select(F.col("__at").alias("i0"), *[F.col(f"i{k}").alias(f"i{n + 1}") for n, k in enumerate(rest)], "v")
    shape = (len(places[0]), *[a.shape[k] for k in rest])
    return GridFrame(rows, F.col("v"), GridLayout(shape, split=(0,), n_blocks=max(1, min(a.layout.n_blocks, shape[0] or 1))), a.dtype, None, a.unit)


def in_unit(a: GridFrame, value: Column, unit, dtype) -> Column:
    """A value to be written, converted to the array's unit or refused. Where units are
    involved, what an integer array can't hold exactly raises when it is computed."""
    if unit is None and a.unit is None:
        return dtypes.cast(value, dtype, a.dtype)
    factor = (unit or DIMENSIONLESS).factor_to(a.unit or DIMENSIONLESS)
    if factor != 1.0:
        value, dtype = value.cast("double") * F.lit(factor), np.dtype(float)
    written = dtypes.cast(value, dtype, a.dtype)
    if a.dtype.kind not in "iu":
        return written
    if np.dtype(dtype).kind == "c":
        raise TypeError("complex values can't be written into an integer array with units")
    lost = F.raise_error(F.lit("a unit assignment to an integer array would lose precision")).cast(dtypes.spark_type(a.dtype))
    limits = np.iinfo(a.dtype)
    if np.dtype(dtype).kind == "f":
        exact = (value == F.rint(value)) & (value >= F.lit(float(limits.min))) & (value < F.lit(float(limits.max) + 1.0))
    else:
        exact = written == value
    return F.when(value.isNull() | exact, written).otherwise(lost)


def assign(a: GridFrame, key, value) -> GridFrame:
    """A new grid with the selected cells set to a number, array or grid."""
    if isinstance(key, np.ndarray) and key.dtype == bool and key.shape == a.shape:
        from gridframe.sources.create import array

        key = array(a.spark, key, layout=a.layout)
    if isinstance(key, GridFrame) and key.dtype == bool:
        return assign_masked(a, key, value)
    basic = basic_index(key, a.shape)
    if basic is None:
        return assign_listed(a, key, value)
    condition = F.lit(True)
    for i, p, n in zip(a.index, basic, a.shape):
        if p != range(n):
            condition = condition & within(F.col(i), p)
    if np.isscalar(value) or (isinstance(value, np.ndarray) and value.ndim == 0):
        new = in_unit(a, dtypes.literal(value), None, np.asarray(value).dtype)
        return a.like(F.when(condition, new).otherwise(a.value))
    kept = [(k, p) for k, p in enumerate(basic) if not isinstance(p, int)]
    shape = tuple(len(p) for _, p in kept)
    rows, source, dtype, unit, size, expression = operand(a, value)
    if len(source) > len(shape) or any(m not in (1, n) for m, n in zip(source[::-1], shape[::-1])):
        raise ValueError(f"could not broadcast {source} into {shape}")
    offset = len(shape) - len(source)
    base = a.base.select(*a.index, a.value.alias("__old"), condition.alias("__in"))
    on, renamed = [], []
    for n, m in enumerate(source):
        k, p = kept[n + offset]
        if m == 1 and len(p) != 1:
            continue
        base = base.withColumn(f"__p{n}", place_in(F.col(f"i{k}"), p))
        on.append(F.col(f"__p{n}") == F.col(f"__s{n}"))
        renamed.append(F.col(f"i{n}").alias(f"__s{n}"))
    rows = rows.select(*renamed, expression.alias("__new"), F.lit(True).alias("__has"))
    matched = F.col("__in")
    for c in on:
        matched = matched & c
    base = base.join(hinted(rows, size), matched, "left")
    new = F.when(F.col("__has"), in_unit(a, F.col("__new"), unit, dtype)).otherwise(F.col("__old"))
    return a.like(new, base=base)


def operand(a: GridFrame, value):
    """rows, shape, dtype, unit, size and value column of an array to be written."""
    if isinstance(value, GridFrame):
        return value.base, value.shape, value.dtype, value.unit, value.size, value.value
    from gridframe.sources.create import array_frame

    value = np.asarray(value)
    return array_frame(a.spark, value), value.shape, value.dtype, None, value.size, F.col("v")


def assign_masked(a: GridFrame, mask: GridFrame, value) -> GridFrame:
    from gridframe.grid import Aligned

    both = Aligned([a, mask])
    if np.isscalar(value) or np.ndim(value) == 0:
        new = in_unit(a, dtypes.literal(value), None, np.asarray(value).dtype)
        return a.like(F.when(both.columns[1], new).otherwise(both.columns[0]), base=both.base)
    rows, source, dtype, unit, size, expression = operand(a, value)
    if len(source) != 1:
        raise ValueError("cells of a mask are set from an array of one axis")
    base = both.base.select(*a.index, both.columns[0].alias("__old"), both.columns[1].alias("__in"))
    flat = ravel([F.col(i) for i in a.index], a.shape)
    places = numbered(base.where("__in").select(*a.index), flat, a.size).select(*a.index, "__at")
    rows = rows.select(F.col("i0").alias("__at"), expression.alias("__new"))
    chosen = places.join(hinted(rows, size), "__at").drop("__at")
    base = base.join(chosen, a.index, "left")
    return a.like(F.when(F.col("__in"), in_unit(a, F.col("__new"), unit, dtype)).otherwise(F.col("__old")), base=base)


def assign_listed(a: GridFrame, key, value) -> GridFrame:
    """Places along the first axes; of places named twice the last one holds."""
    arrays = [np.asarray(k) for k in (key if isinstance(key, tuple) else (key,))]
    if any(x.dtype.kind not in "iu" or x.ndim > 1 for x in arrays) or len(arrays) > a.ndim:
        raise IndexError("only integers, slices, an ellipsis, masks and lists of integers are indices")
    places = np.stack([x % n for x, n in zip(np.broadcast_arrays(*arrays), a.shape)])
    last = {tuple(p): k for k, p in enumerate(places.T.tolist())}
    import pyarrow as pa

    names = [f"i{k}" for k in range(len(places))]
    wanted = pa.Table.from_arrays([pa.array([p[k] for p in last], pa.int64()) for k in range(len(places))] + [pa.array(list(last.values()), pa.int64())], names=[*names, "__n"])
    base = a.base.select(*a.index, a.value.alias("__old")).join(hinted(a.spark.createDataFrame(wanted), len(last)), names, "left")
    if np.isscalar(value):
        new = in_unit(a, dtypes.literal(value), None, np.asarray(value).dtype)
        return a.like(F.when(F.col("__n").isNotNull(), new).otherwise(F.col("__old")), base=base)
    rows, source, dtype, unit, size, expression = operand(a, value)
    rest = [f"i{k}" for k in range(len(places), a.ndim)]
    rows = rows.select(F.col("i0").alias("__n"), *[F.col(f"i{n + 1}").alias(i) for n, i in enumerate(rest)], expression.alias("__new"), F.lit(True).alias("__has"))
    base = base.join(hinted(rows, size), ["__n", *rest], "left")
    return a.like(F.when(F.col("__has"), in_unit(a, F.col("__new"), unit, dtype)).otherwise(F.col("__old")), base=base)



