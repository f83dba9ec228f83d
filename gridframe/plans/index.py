"""Index columns of a grid: i0, i1, ..., as Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.plans.layout import GridLayout


def axes(ndim: int) -> list[str]:
    return [f"i{k}" for k in range(ndim)]


def strides(shape: Sequence[int]) -> list[int]:
    """Row-major strides, in cells."""
    return list(accumulate([1, *list(shape)[:0:-1]], lambda a, b: a * b))[::-1] if len(shape) else []


def unravel(flat: Column, shape: Sequence[int]) -> list[Column]:
    """The index along each axis of a row-major position."""
    out = []
    for k, (n, s) in enumerate(zip(shape, strides(shape))):
        at = whole(flat, s)
        out.append((at % F.lit(n) if k else at).cast("long").alias(f"i{k}"))
    return out


def ravel(index: Sequence[Column], shape: Sequence[int]) -> Column:
    """The row-major position of an index."""
    at = F.lit(0).cast("long")
    for i, n in zip(index, shape):
        at = at * F.lit(int(n)) + i
    return at


def part_of(i: Column, cuts: Sequence[int]) -> Column:
    """The number of the part between cuts that an index lies in. Near-equal parts,
    longer ones first, have a closed form; others are counted by their cuts."""
    n, length = len(cuts) - 1, cuts[-1]
    if n == 1:
        return F.lit(0).cast("long")
    size, longer = divmod(length, n)
    if all(c == k * size + min(k, longer) for k, c in enumerate(cuts)):
        edge = longer * (size + 1)
        return F.when(i < edge, whole(i, size + 1)).otherwise(longer + whole(i - edge, size)).cast("long")
    return sum((F.when(i >= c, 1).otherwise(0) for c in cuts[1:-1]), F.lit(0)).cast("long")


def whole(i: Column, n: int) -> Column:
    """i div n, rounded towards zero."""
    return F.call_function("div", i, F.lit(n)) if n > 1 else i


def block_of(index: Sequence[Column], layout: GridLayout) -> Column:
    """The block that owns a cell."""
    block = F.lit(0).cast("long")
    for i, cuts, p in zip(index, layout.bounds, layout.grid):
        block = block * F.lit(p) + part_of(i, cuts)
    return block


def cells(spark, shape: Sequence[int], partitions: int | None = None) -> DataFrame:
    """All indices of a grid, in row-major order, a row each."""
    size = 1
    for n in shape:
        size *= int(n)
    flat = spark.range(0, size, 1, partitions) if partitions else spark.range(size)
    return flat.select(*unravel(F.col("id"), shape)) if len(shape) else flat.select()
