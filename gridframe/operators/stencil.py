"""Linear operators given by offsets and coefficients.

apply() sends each cell's value, times a coefficient, to the cells that use it,
and adds up by target: one explode and one aggregation, whatever the blocks. A
cell that lies beyond a wall is what the boundary says. apply_blocks() runs the
same operator on blocks with ghosts, by NumPy, several steps at a time if the
halo is wide enough.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.functions import dtypes
from gridframe.functions.units import DIMENSIONLESS
from gridframe.grid import GridFrame
from gridframe.operators.halo import checked_boundary, with_images
from gridframe.operators.placement import numbering_column
from gridframe.operators.tiles import TileFrame, fill_walls, tiled_layout
from gridframe.plans.index import axes
from gridframe.plans.layout import GridLayout
from gridframe.profiling import watched

Offset = tuple[int, ...]


class StencilOperator:
    """sum over offsets o of c[o] u[i + o]; overrides give single rows terms of their own.

    Coefficients are numbers, or grids of one coefficient a cell."""

    def __init__(self, layout: GridLayout, terms: Mapping[Offset, Any] | Sequence[tuple[Offset, Any]], overrides: Mapping[Offset, Sequence[tuple[Offset, float]]] | None = None):
        pairs = list(terms.items()) if isinstance(terms, Mapping) else list(terms)
        pairs = [((o,) if isinstance(o, int) else tuple(o), c) for o, c in pairs]
        if len({o for o, _ in pairs}) != len(pairs):
            raise ValueError("offsets must be unique")
        self.layout, self.terms, self.overrides = layout, dict(pairs), {}
        for o in self.terms:
            self._check(o)
        for row, own in (overrides or {}).items():
            row = (row,) if isinstance(row, int) else tuple(row)
            layout.owner(row)
            row = tuple(i % n for i, n in zip(row, layout.shape))
            own = [((o,) if isinstance(o, int) else tuple(o), c) for o, c in own]
            for o, _ in own:
                self._check(o)
            self.overrides[row] = own
        for c in self.terms.values():
            if isinstance(c, GridFrame) and c.shape != layout.shape:
                raise ValueError("coefficients need the grid's shape")

    def _check(self, offset: Offset) -> None:
        if len(offset) != self.layout.ndim:
            raise ValueError(f"offsets need {self.layout.ndim} entries")
        for k, (o, h) in enumerate(zip(offset, self.layout.halo)):
            if abs(o) > h:
                raise ValueError(f"offset {o} reaches beyond the halo {h} along axis {k}")

    def reach(self) -> tuple[int, ...]:
        every = [*self.terms, *(o for own in self.overrides.values() for o, _ in own)]
        return tuple(max((abs(o[k]) for o in every), default=0) for k in range(self.layout.ndim))

    # Algebra

    def _combined(self, other: StencilOperator, sign: int) -> StencilOperator:
        if self.layout != other.layout:
            raise ValueError("Layouts must match")
        terms = dict(self.terms)
        for o, c in other.terms.items():
            terms[o] = terms[o] + sign * c if o in terms else sign * c
        overrides = {}
        for row in {*self.overrides, *other.overrides}:
            merged: dict[Offset, Any] = {}
            for op, s in ((self, 1), (other, sign)):
                for o, c in op.overrides.get(row, list(op.terms.items())):
                    if isinstance(c, GridFrame):
                        c = c.get(*row)
                    merged[o] = merged.get(o, 0) + s * c
            overrides[row] = list(merged.items())
        return StencilOperator(self.layout, terms, overrides)

    def __add__(self, other: StencilOperator) -> StencilOperator:
        return self._combined(other, 1)

    def __sub__(self, other: StencilOperator) -> StencilOperator:
        return self._combined(other, -1)

    def __mul__(self, number) -> StencilOperator:
        if not np.isscalar(number):
            return NotImplemented
        return StencilOperator(self.layout, {o: c * number for o, c in self.terms.items()}, {r: [(o, c * number) for o, c in own] for r, own in self.overrides.items()})

    __rmul__ = __mul__

    def __neg__(self) -> StencilOperator:
        return self * -1

    # Application

    def _source(self, index, offset: Offset, boundary: Any):
        """For a target index: the source cell along each axis, and if it exists."""
        out, exists = [], F.lit(True)
        for i, o, n, wraps in zip(index, offset, self.layout.shape, self.layout.periodic):
            g = i + F.lit(o)
            if o and wraps:
                g = F.pmod(g, F.lit(n))
            elif o and boundary == "edge":
                g = F.greatest(F.lit(0), F.least(g, F.lit(n - 1)))
            elif o and boundary == "symmetric":
                g = F.when(g < 0, -g - 1).when(g >= n, 2 * n - 1 - g).otherwise(g)
            elif o and boundary == "reflect":
                g = F.when(g < 0, -g).when(g >= n, 2 * n - 2 - g).otherwise(g)
            elif o:
                exists = exists & g.between(0, n - 1)
            out.append(g.cast("long"))
        return out, exists

    def matrix(self, boundary: Any = None) -> DataFrame:
        """t0..., s0..., c and wall: for each target cell and term the source cell and
        coefficient; with wall set where the source lies beyond a constant wall."""
        from gridframe.plans.index import cells

        spark = self._spark
        names = axes(self.layout.ndim)
        base = cells(spark, self.layout.shape)
        for n, c in enumerate(self.terms.values()):
            if isinstance(c, GridFrame):
                base = base.join(c.base.select(*names, c.value.cast("double").alias(f"__c{n}")), names)
        index = [F.col(i) for i in names]
        parts = []
        for n, (o, c) in enumerate(self.terms.items()):
            source, exists = self._source(index, o, boundary)
            value = F.col(f"__c{n}") if isinstance(c, GridFrame) else F.lit(c)
            parts.append(F.struct(*[s.alias(f"s{k}") for k, s in enumerate(source)], value.alias("c"), (~exists).alias("wall")))
        rows = base.select(*[i.alias(f"t{k}") for k, i in enumerate(index)], F.explode(F.array(*parts)).alias("m")).select(*[f"t{k}" for k in range(len(names))], "m.*")
        if self.overrides:
            special = F.struct(*[F.col(f"t{k}") for k in range(len(names))]).isin([F.struct(*[F.lit(x).cast("long").alias(f"t{k}") for k, x in enumerate(row)]) for row in self.overrides])
            rows = rows.where(~special)
            own = []
            for row, terms in self.overrides.items():
                for o, c in terms:
                    wall, source = False, []
                    for i, d, n, wraps in zip(row, o, self.layout.shape, self.layout.periodic):
                        g = i + d
                        from gridframe.operators.halo import source_of

                        s = source_of(g, n, wraps, boundary)
                        wall |= s is None
                        source.append(g if s is None else s)
                    own.append((*row, *source, c, wall))
            kinds = ", ".join([*(f"t{k} long" for k in range(len(names))), *(f"s{k} long" for k in range(len(names))), f"c {rows.schema['c'].dataType.simpleString()}", "wall boolean"])
            kind = float if rows.schema["c"].dataType.simpleString() in ("double", "float") else int
            if own:
                rows = rows.unionByName(spark.createDataFrame([(*r[:-2], kind(r[-2]), r[-1]) for r in own], kinds))
        return rows

    def apply(self, u: GridFrame, boundary: Any = None) -> GridFrame:
        """The operator on u: integer grids with real coefficients give doubles."""
        if u.layout != self.layout:
            raise ValueError("Layouts must match")
        boundary = checked_boundary(boundary, self.layout)
        constant = 0 if boundary is None or isinstance(boundary, str) else boundary
        names = axes(self.layout.ndim)
        self._spark = u.spark
        kinds = [c.dtype if isinstance(c, GridFrame) else np.asarray(c).dtype for c in self.terms.values()] or [np.dtype(float)]
        dtype = np.result_type(u.dtype, *kinds, *[np.asarray(c).dtype for own in self.overrides.values() for _, c in own])
        value = dtypes.cast(u.value, u.dtype, dtype)
        if not self.overrides and not any(isinstance(c, GridFrame) for c in self.terms.values()):
            out = self._scattered(u, value, boundary, constant).groupBy(*names).agg(F.sum("w").cast(dtypes.spark_type(dtype)).alias("v"))
        else:
            out = self._gathered(u, value, boundary, constant, dtype)
        return GridFrame(out, F.col("v"), self.layout, dtype, u.dims, u.unit if u.unit not in (None, DIMENSIONLESS) else None)

    def _imaged(self, u: GridFrame, value, boundary: Any) -> DataFrame:
        """u's cells as i0... and w. Beyond named walls a cell also stands for its images."""
        rows = watched(u.base, "stencil").select(*u.index, value.alias("w"))
        for k, (n, h) in enumerate(zip(self.layout.shape, self.reach())):
            rows = rows if self.layout.periodic[k] else with_images(rows, k, n, h, False, boundary)
        return rows

    def _target(self, index, offset: Offset, boundary: Any):
        """The cell that uses a cell or image under an offset, and whether it exists."""
        target, exists = self._source(index, tuple(-d for d in offset), None)
        for t, n in zip(target, self.layout.shape) if isinstance(boundary, str) else ():
            exists = exists & t.between(0, n - 1)  # also where the offset is 0: an image stays beyond
        return target, exists

    def _scattered(self, u: GridFrame, value, boundary: Any, constant) -> DataFrame:
        """Each cell's share of its targets: no join. A share of its own keeps every cell
        in the result, and brings what its terms find beyond constant walls."""
        index = [F.col(i) for i in u.index]
        inside, wall = F.lit(True), F.lit(0)
        for i, n in zip(index, self.layout.shape):
            inside = inside & i.between(0, n - 1)
        parts = []
        for o, c in self.terms.items():
            target, exists = self._target(index, o, boundary)
            parts.append(F.struct(*[t.alias(f"i{k}") for k, t in enumerate(target)], (F.col("w") * F.lit(c)).alias("w"), exists.alias("__in")))
            if constant != 0:
                wall = wall + F.when(self._source(index, o, None)[1], F.lit(0)).otherwise(F.lit(c * constant))
        parts.append(F.struct(*[i.alias(f"i{k}") for k, i in enumerate(index)], wall.alias("w"), inside.alias("__in")))
        spread = self._imaged(u, value, boundary).select(F.explode(F.array(*parts)).alias("m")).select("m.*")
        return spread.where("__in").select(*u.index, "w")

    def _gathered(self, u: GridFrame, value, boundary: Any, constant, dtype) -> DataFrame:
        """What each cell's terms find is gathered into one row a cell, a column an
        offset; coefficients join these rows once for each frame that holds some, and
        overrides are a small table of coefficients by row."""
        names, index = u.index, [F.col(i) for i in u.index]
        offsets = list(dict.fromkeys([*self.terms, *(o for own in self.overrides.values() for o, _ in own), (0,) * self.layout.ndim]))
        parts = []
        for n, o in enumerate(offsets):
            target, exists = self._target(index, o, boundary)
            parts.append(F.struct(*[t.alias(f"i{k}") for k, t in enumerate(target)], F.lit(n).alias("__n"), F.col("w"), exists.alias("__in")))
        spread = self._imaged(u, value, boundary).select(F.explode(F.array(*parts)).alias("m")).select("m.*").where("__in")
        rows = spread.groupBy(*names).agg(*[F.first(F.when(F.col("__n") == n, F.col("w")), ignorenulls=True).alias(f"__u{n}") for n in range(len(offsets))])
        held: list[tuple[DataFrame, list[tuple[int, GridFrame]]]] = []
        for n, o in enumerate(offsets):
            c = self.terms.get(o)
            if isinstance(c, GridFrame):
                own = next((x for base, x in held if base is c.base), None)
                if own is None:
                    held.append((c.base, [(n, c)]))
                else:
                    own.append((n, c))
        for base, own in held:
            rows = rows.join(base.select(*names, *[c.value.alias(f"__c{n}") for n, c in own]), names)
        if self.overrides:
            kind = "double" if any(isinstance(c, float) for own in self.overrides.values() for _, c in own) else "long"
            listed = []
            for row, own in self.overrides.items():
                sums = dict.fromkeys(offsets)
                for o, c in own:
                    sums[o] = (sums[o] or 0) + c
                listed.append((*row, [None if c is None else float(c) if kind == "double" else int(c) for c in sums.values()]))
            rows = rows.join(F.broadcast(u.spark.createDataFrame(listed, ", ".join([*(f"{i} long" for i in names), f"__own array<{kind}>"]))), names, "left")
        found = [F.coalesce(F.col(f"__u{n}"), dtypes.cast(F.lit(constant), np.asarray(constant).dtype, dtype)) for n in range(len(offsets))]
        zero = dtypes.cast(F.lit(0), np.int64, dtype)
        plain = zero
        for n, o in enumerate(offsets):
            if o in self.terms:
                c = self.terms[o]
                plain = plain + found[n] * (F.col(f"__c{n}") if isinstance(c, GridFrame) else F.lit(c))
        if self.overrides:
            special = zero
            for n in range(len(offsets)):
                special = special + F.coalesce(found[n] * F.col("__own")[n], zero)
            plain = F.when(F.col("__own").isNotNull(), special).otherwise(plain)
        return rows.select(*names, plain.cast(dtypes.spark_type(dtype)).alias("v"))

    def apply_blocks(self, u: GridFrame, boundary: Any = None, steps: int = 1) -> GridFrame:
        """The operator `steps` times on blocks with ghosts: one exchange for all steps,
        which gathers cells into tiles. Needs constant coefficients and a halo of steps
        times the reach."""
        if u.layout != self.layout:
            raise ValueError("Layouts must match")
        tiles = TileFrame.from_grid(u, self._walls(boundary), tiled_layout(self.layout))
        return self._stepped(tiles, boundary, steps).to_grid(self.layout)

    def apply_tiles(self, u: TileFrame, boundary: Any = None, steps: int = 1) -> TileFrame:
        """The operator `steps` times on stored tiles, which stay where they lie: one
        exchange of faces for all steps. The result's ghosts are 0."""
        if u.shape != self.layout.shape or u.layout.options() != self.layout.options():
            raise ValueError("Layouts must match")
        return self._stepped(u.update_halos(self._walls(boundary)), boundary, steps)

    @staticmethod
    def _walls(boundary: Any) -> Any:
        return "zero" if boundary is None else boundary

    def _stepped(self, tiles: TileFrame, boundary: Any, steps: int) -> TileFrame:
        """Steps within tiles whose ghosts are filled. What is right shrinks by the reach
        each step, but at walls, beyond which cells are set anew from those inside."""
        reach, layout, terms = self.reach(), tiles.layout, list(self.terms.items())
        if self.overrides or any(isinstance(c, GridFrame) for c in self.terms.values()):
            raise ValueError("block kernels need constant coefficients without overrides")
        if any(h < steps * r for h, r in zip(layout.halo, reach)):
            raise ValueError("the halo is too narrow for so many steps")
        boundary = self._walls(checked_boundary(boundary, layout))
        dtype = np.result_type(tiles.dtype, *[np.asarray(c).dtype for _, c in terms])

        def run(data: np.ndarray, block: int) -> np.ndarray:
            data = data.astype(dtype)
            for step in range(steps):
                new = np.zeros_like(data)
                core = tuple(slice(r, n - r) for r, n in zip(reach, data.shape))
                for o, c in terms:
                    new[core] += c * data[tuple(slice(r + d, n - r + d) for r, d, n in zip(reach, o, data.shape))]
                data = new
                if step < steps - 1:
                    fill_walls(data, layout, block, boundary)
            out = np.zeros_like(data)
            out[layout.interior] = data[layout.interior]
            return out

        return tiles.map_tiles(run, dtype)

    def to_matrix_frame(self, u: GridFrame) -> DataFrame:
        """(row, col, value) of the matrix, in block numbering; cells beyond walls are omitted."""
        self._spark = u.spark
        names = range(self.layout.ndim)
        rows = self.matrix(None).where(~F.col("wall"))
        row = numbering_column(self.layout, [F.col(f"t{k}") for k in names])
        col = numbering_column(self.layout, [F.col(f"s{k}") for k in names])
        return rows.select(row.alias("row"), col.alias("col"), F.col("c").cast("double").alias("value")).groupBy("row", "col").agg(F.sum("value").alias("value"))
