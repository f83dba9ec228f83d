"""Blocks with ghost cells.

A BlockFrame has a row for every stored cell: block, the cell's global index
(beyond the edges it runs on, below 0 or past the end), whether it is a ghost,
and v. Which blocks store a cell, and under which indices, follows from its index
in closed form, axis by axis: a projection copies the few cells near a cut or a
wall, corners included, without a join. Sums flow back by one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.functions import dtypes
from gridframe.grid import GridFrame
from gridframe.plans.index import axes, cells, part_of, whole
from gridframe.plans.layout import GridLayout

BOUNDARIES = (None, "zero", "edge", "symmetric", "reflect")


def checked_boundary(boundary: Any, layout: GridLayout) -> Any:
    if isinstance(boundary, (bool, np.bool_)) or not (boundary in BOUNDARIES if isinstance(boundary, str) or boundary is None else isinstance(boundary, (int, float, complex, np.number))):
        raise ValueError(f"unknown boundary {boundary!r}")
    if boundary in ("reflect", "symmetric"):
        for axis, (cuts, h, wraps) in enumerate(zip(layout.bounds, layout.halo, layout.periodic)):
            need = h + (boundary == "reflect")
            if h and not wraps and min(cuts[1] - cuts[0], cuts[-1] - cuts[-2]) < need:
                raise ValueError(f"{boundary} needs blocks of {need} cells along axis {axis}")
    return boundary


def source_of(g: int, n: int, wraps: bool, boundary: Any) -> int | None:
    """The cell that index g of an axis stands for; None: a constant or the old value."""
    if 0 <= g < n:
        return g
    if wraps:
        return g % n
    if boundary == "edge":
        return 0 if g < 0 else n - 1
    if boundary == "symmetric":
        return -g - 1 if g < 0 else 2 * n - 1 - g
    if boundary == "reflect":
        return -g if g < 0 else 2 * n - 2 - g
    return None


def with_images(rows: DataFrame, k: int, n: int, h: int, wraps: bool, boundary: Any) -> DataFrame:
    """Each row once for every index from -h to n + h - 1 that stands for its cell along
    axis k (source_of, the other way round). Most cells stand for themselves alone."""
    i = F.col(f"i{k}")
    if not h or not (wraps or boundary in ("edge", "symmetric", "reflect")):
        return rows
    rest = [F.col(c) for c in rows.columns if c != f"i{k}"]
    if wraps:
        rounds = F.sequence(-whole(i + F.lit(h), n), whole(F.lit(n + h - 1) - i, n))
        rows = rows.select(*rest, i, F.explode(rounds).alias("__round"))
        return rows.select(*rest, (i + F.lit(n) * F.col("__round")).alias(f"i{k}"))
    if boundary == "edge":
        found = F.sequence(F.when(i == 0, F.lit(-h)).otherwise(i), F.when(i == n - 1, F.lit(n - 1 + h)).otherwise(i))
    else:
        near = int(boundary == "reflect")  # the first cell that is mirrored
        low, high = F.lit(near - 1) - i, F.lit(2 * n - 1 - near) - i
        at_low, at_high = i.between(near, near + h - 1), i.between(n - near - h, n - near - 1)
        found = F.when(at_low & at_high, F.array(low, i, high)).when(at_low, F.array(low, i)).when(at_high, F.array(i, high)).otherwise(F.array(i))
    return rows.select(*rest, F.explode(found).alias(f"i{k}"))


def with_parts(rows: DataFrame, layout: GridLayout, k: int) -> DataFrame:
    """Each row once for every part of axis k that stores its index, as __p{k}: those
    between the parts of the cells a halo before and a halo after."""
    g, n, h, cuts = F.col(f"i{k}"), layout.shape[k], layout.halo[k], layout.bounds[k]
    if not h or len(cuts) == 2:
        return rows.select("*", part_of(g, cuts).alias(f"__p{k}"))
    first, last = part_of(F.greatest(g - F.lit(h), F.lit(0)), cuts), part_of(F.least(g + F.lit(h), F.lit(n - 1)), cuts)
    return rows.select("*", F.explode(F.sequence(first, last)).alias(f"__p{k}"))


def numbered_block(layout: GridLayout) -> Column:
    block = F.lit(0).cast("long")
    for k, p in enumerate(layout.grid):
        block = block * F.lit(p) + F.col(f"__p{k}")
    return block.alias("block")


class BlockFrame:
    """Stored cells of all blocks: (block, i0..., ghost, v)."""

    def __init__(self, rows: DataFrame, layout: GridLayout, dtype, dims=None, unit=None):
        self.rows, self.layout, self.dtype, self.dims, self.unit = rows, layout, np.dtype(dtype), dims, unit

    @property
    def index(self) -> list[str]:
        return axes(self.layout.ndim)

    @classmethod
    def from_grid(cls, a: GridFrame, boundary: Any = None) -> BlockFrame:
        """The grid's blocks, ghosts filled; constants and None (0) beyond walls."""
        layout, spark = a.layout, a.spark
        boundary = checked_boundary(boundary, layout)
        fill = 0 if boundary is None or isinstance(boundary, str) else boundary
        rows = a.df
        for k, (n, h, wraps) in enumerate(zip(layout.shape, layout.halo, layout.periodic)):
            rows = with_parts(with_images(rows, k, n, h, wraps, boundary), layout, k)
        found = rows.select(numbered_block(layout), *axes(layout.ndim), "v")
        if any(h and not w for h, w in zip(layout.halo, layout.periodic)) and (boundary in (None, "zero") or not isinstance(boundary, str)):
            found = found.unionByName(outside(spark, layout, fill, a.dtype))
        rows = found.select("block", *axes(layout.ndim), ghost_column(layout).alias("ghost"), "v")
        return cls(rows, layout, a.dtype, a.dims, a.unit)

    def to_grid(self) -> GridFrame:
        """The blocks' own cells."""
        return GridFrame(self.rows.where(~F.col("ghost")).select(*self.index, "v"), F.col("v"), self.layout, self.dtype, self.dims, self.unit)

    def update_halos(self, boundary: Any = None, axis: int | None = None) -> BlockFrame:
        """Ghosts filled anew from their owners. None keeps what stands beyond walls;
        axis: only ghosts outside along that axis."""
        fresh = BlockFrame.from_grid(self.to_grid(), boundary)
        keeps = boundary is None
        if not keeps and axis is None:
            return fresh
        old = self.rows.select("block", *self.index, F.col("v").alias("__old"))
        both = fresh.rows.join(old, ["block", *self.index])
        keep = F.lit(False)
        if keeps:
            for k, (n, w) in enumerate(zip(self.layout.shape, self.layout.periodic)):
                if not w:
                    keep = keep | ~F.col(f"i{k}").between(0, n - 1)
        if axis is not None:
            keep = keep | (F.col("ghost") & ~only_outside(self.layout, axis))
        value = F.when(keep, F.col("__old")).otherwise(F.col("v"))
        return self.with_rows(both.select("block", *self.index, "ghost", value.alias("v")))

    def with_rows(self, rows: DataFrame) -> BlockFrame:
        return BlockFrame(rows, self.layout, self.dtype, self.dims, self.unit)

    def accumulate_halos(self, axis: int | None = None) -> BlockFrame:
        """Ghost values added to the cells they stand for, then zeroed; what lies
        beyond walls is dropped. axis: only ghosts outside along that axis."""
        if axis is not None:
            return self._accumulate_along(axis)
        inside, index = F.lit(True), []
        for k, (n, w) in enumerate(zip(self.layout.shape, self.layout.periodic)):
            i = F.col(f"i{k}")
            if not w:
                inside = inside & i.between(0, n - 1)
            index.append((F.pmod(i, F.lit(n)) if w else i).alias(f"i{k}"))
        value = dtypes.cast(F.col("v"), self.dtype, self.dtype)
        sums = self.rows.where(inside).select(*index, value.alias("v")).groupBy(*self.index).agg(F.sum("v").cast(dtypes.spark_type(self.dtype)).alias("v"))
        grid = GridFrame(sums, F.col("v"), self.layout, self.dtype, self.dims, self.unit)
        return BlockFrame.from_grid(grid, "zero").clear_halos()

    def _accumulate_along(self, axis: int) -> BlockFrame:
        """Each ghost outside along an axis goes to the block that owns its place there,
        at the same place along the other axes, which may be a ghost's."""
        layout, i, n, stride = self.layout, F.col(f"i{axis}"), self.layout.shape[axis], 1
        for p in layout.grid[axis + 1 :]:
            stride *= p
        gone, wraps = only_outside(layout, axis), layout.periodic[axis]
        at = F.pmod(i, F.lit(n)).cast("long") if wraps else i
        part = F.call_function("div", F.col("block"), F.lit(stride)) % F.lit(layout.grid[axis])
        block = F.col("block") + (part_of(at, layout.bounds[axis]) - part) * F.lit(stride)
        moved = self.rows.where(gone if wraps else gone & i.between(0, n - 1))
        moved = moved.select(block.alias("block"), *[(at if k == axis else F.col(f"i{k}")).alias(f"i{k}") for k in range(layout.ndim)], "v")
        zero = dtypes.cast(F.lit(0), np.int64, self.dtype)
        kept = self.rows.select("block", *self.index, F.when(gone, zero).otherwise(F.col("v")).alias("v"))
        sums = kept.unionByName(moved).groupBy("block", *self.index).agg(F.sum("v").cast(dtypes.spark_type(self.dtype)).alias("v"))
        return self.with_rows(sums.select("block", *self.index, ghost_column(layout).alias("ghost"), "v"))

    def clear_halos(self, axis: int | None = None) -> BlockFrame:
        gone = F.col("ghost") if axis is None else only_outside(self.layout, axis)
        zero = dtypes.cast(F.lit(0), np.int64, self.dtype)
        return self.with_rows(self.rows.select("block", *self.index, "ghost", F.when(gone, zero).otherwise(F.col("v")).alias("v")))

    def map_blocks(self, function: Callable[[np.ndarray, int], np.ndarray], dtype=None) -> BlockFrame:
        """Each block's storage through a NumPy function of (array with ghosts, block
        number), in one task a block; shapes stay."""
        layout, index, own = self.layout, self.index, self.dtype
        dtype = np.dtype(dtype or own)

        def run(table: pa.Table) -> pa.Table:
            from gridframe.sources.create import value_array

            block = table.column("block")[0].as_py()
            at = tuple(table.column(i).to_numpy() - a + h for i, (a, _), h in zip(index, layout.index_bounds(block), layout.halo))
            data = np.zeros(layout.storage_shape(block), own)
            data[at] = table.column("v").to_numpy()
            made = np.asarray(function(data, block)).astype(dtype)
            return table.set_column(table.schema.get_field_index("v"), "v", value_array(made[at]))

        schema = ", ".join(["block long", *(f"{i} long" for i in index), "ghost boolean", f"v {dtypes.spark_type(dtype)}"])
        rows = self.rows.select("block", *index, "ghost", "v").groupBy("block").applyInArrow(run, schema)
        return BlockFrame(rows, layout, dtype, self.dims, self.unit)


class HaloUpdate:
    """A pending update. Frames are lazy, so there is nothing to wait for."""

    def __init__(self, blocks: BlockFrame):
        self.blocks = blocks
        self.done = True

    def wait(self) -> BlockFrame:
        return self.blocks


def start_halo_update(blocks: BlockFrame, boundary: Any = None) -> HaloUpdate:
    return HaloUpdate(blocks.update_halos(boundary))


def ghost_column(layout: GridLayout) -> Column:
    """Whether a stored cell (block, i0...) lies outside of its block."""
    ghost, left = F.lit(False), F.col("block")
    for k in range(layout.ndim - 1, -1, -1):
        p = layout.grid[k]
        part = left % F.lit(p) if k else left
        left = F.call_function("div", left, F.lit(p)) if p > 1 else left
        from gridframe.operators.placement import pick

        low, high = pick(part, layout.bounds[k][:-1]), pick(part, layout.bounds[k][1:])
        ghost = ghost | (F.col(f"i{k}") < low) | (F.col(f"i{k}") >= high)
    return ghost


def only_outside(layout: GridLayout, axis: int) -> Column:
    """Whether a stored cell lies outside of its block along an axis."""
    from gridframe.operators.placement import pick

    part = F.col("block")
    for k in range(layout.ndim - 1, axis, -1):
        part = F.call_function("div", part, F.lit(layout.grid[k]))
    part = part % F.lit(layout.grid[axis])
    i = F.col(f"i{axis}")
    return (i < pick(part, layout.bounds[axis][:-1])) | (i >= pick(part, layout.bounds[axis][1:]))


def outside(spark: SparkSession, layout: GridLayout, fill, dtype) -> DataFrame:
    """Stored cells beyond walls, at a constant: for each axis, those that are beyond
    along it and not along an axis before. They are counted off a range, spread over
    the executors."""
    frames = []
    for k in range(layout.ndim):
        if not layout.halo[k] or layout.periodic[k]:
            continue
        lengths, index = [], []
        for j, (n, h) in enumerate(zip(layout.shape, layout.halo)):
            i = F.col(f"i{j}")
            inner = j < k and not layout.periodic[j]
            lengths.append(2 * h if j == k else n if inner else n + 2 * h)
            index.append(F.when(i < h, i - F.lit(h)).otherwise(i + F.lit(n - h)) if j == k else i if inner else i - F.lit(h))
        rows = cells(spark, lengths).select(*[i.alias(f"i{j}") for j, i in enumerate(index)])
        for j in range(layout.ndim):
            rows = with_parts(rows, layout, j)
        value = dtypes.cast(dtypes.literal(fill), np.asarray(fill).dtype, dtype)
        frames.append(rows.select(numbered_block(layout), *axes(layout.ndim), value.alias("v")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
