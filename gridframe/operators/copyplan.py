"""Boxes copied between grids: filters and shifts, in place of what the targets have there.

All sources are read before any target is written; where target boxes overlap,
the last copy holds. Target boxes may reach into ghost cells beyond walls of a
BlockFrame target.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridframe.functions import dtypes
from gridframe.grid import GridFrame
from gridframe.operators.halo import BlockFrame, ghost_column, numbered_block, with_parts
from gridframe.plans.layout import overlap

Box = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Copy:
    source: int
    source_box: Box
    target: int
    target_box: Box


class CopyPlan:
    """Copies (source number, box, target number, box) between lists of grids."""

    def __init__(self, sources: Sequence[GridFrame], targets: Sequence[GridFrame | BlockFrame], copies: Sequence[Copy | tuple]):
        self.copies = [c if isinstance(c, Copy) else Copy(*c) for c in copies]
        self.source_layouts = [s.layout for s in sources]
        self.target_layouts = [t.layout for t in targets]
        kinds = {np.dtype(x.dtype) for x in [*sources, *targets]}
        if len(kinds) > 1:
            raise ValueError("sources and targets need one dtype")
        for c in self.copies:
            if len(c.source_box) != len(c.target_box) or any(b - a != d - e for (a, b), (e, d) in zip(c.source_box, c.target_box)):
                raise ValueError("boxes must have one shape")
            self._inside(c.source_box, self.source_layouts[c.source], False)
            self._inside(c.target_box, self.target_layouts[c.target], isinstance(targets[c.target], BlockFrame))

    @staticmethod
    def _inside(box: Box, layout, ghosts: bool) -> None:
        if len(box) != layout.ndim:
            raise ValueError(f"a box needs {layout.ndim} ranges")
        for (a, b), n, h, w in zip(box, layout.shape, layout.halo, layout.periodic):
            room = h if ghosts and not w else 0
            if not -room <= a <= b <= n + room:
                raise ValueError(f"box {box} reaches outside")

    @property
    def num_copies(self) -> int:
        return len(self.copies)

    @property
    def num_sent(self) -> int:
        """Cells that are copied."""
        return sum(int(np.prod([b - a for a, b in c.source_box])) for c in self.copies)

    def execute(self, sources: Sequence[GridFrame], targets: Sequence[GridFrame | BlockFrame]) -> list[GridFrame | BlockFrame]:
        """The targets after all copies."""
        if [s.layout for s in sources] != self.source_layouts or [t.layout for t in targets] != self.target_layouts:
            raise ValueError("Layouts must match")
        return [self._written(k, sources, t) for k, t in enumerate(targets)]

    def _written(self, k: int, sources: Sequence[GridFrame], target):
        """Boxes are dense, so a cell of the target either lies in one and is what the last
        copy brings, or stays: both follow from its index, and nothing is joined."""
        own = [(n, c) for n, c in enumerate(self.copies) if c.target == k and all(a < b for a, b in c.target_box)]
        if not own:
            return target
        names = [f"i{n}" for n in range(target.layout.ndim)]
        incoming = None
        for number, c in own:
            rows = sources[c.source].base.where(in_box(names, c.source_box))
            shifted = [(F.col(i) + F.lit(e - a)).alias(i) for i, (a, _), (e, _) in zip(names, c.source_box, c.target_box)]
            rows = rows.select(*shifted, dtypes.cast(sources[c.source].value, sources[c.source].dtype, target.dtype).alias("v"))
            for later, other in own:
                if later > number and overlap(c.target_box, other.target_box):
                    rows = rows.where(~in_box(names, other.target_box))
            incoming = rows if incoming is None else incoming.unionByName(rows)
        written = F.lit(False)
        for _, c in own:
            written = written | in_box(names, c.target_box)
        if not isinstance(target, BlockFrame):
            rows = target.df.where(~written).unionByName(incoming)
            return target.like(F.col("v"), base=rows)
        # Ghosts between blocks stay; own cells and those beyond walls are written.
        beyond = F.lit(False)
        for i, n in zip(names, target.layout.shape):
            beyond = beyond | ~F.col(i).between(0, n - 1)
        for n in range(target.layout.ndim):
            incoming = with_parts(incoming, target.layout, n)
        incoming = incoming.select(numbered_block(target.layout), *names, "v").withColumn("ghost", ghost_column(target.layout))
        takes = ~F.col("ghost") | beyond
        rows = target.rows.where(~(written & takes)).select("block", *names, "ghost", "v")
        return target.with_rows(rows.unionByName(incoming.where(takes)))


def in_box(names: Sequence[str], box: Box) -> Column:
    """Whether an index lies in a box."""
    inside = F.lit(True)
    for i, (a, b) in zip(names, box):
        inside = inside & F.col(i).between(a, b - 1)
    return inside


def copy_boxes(sources: Sequence[GridFrame], targets: Sequence[GridFrame | BlockFrame], copies: Sequence[Copy | tuple]) -> list[GridFrame | BlockFrame]:
    return CopyPlan(sources, targets, copies).execute(sources, targets)
