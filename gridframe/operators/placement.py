"""Which block a cell belongs to: physical placement, load balance, migration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.grid import GridFrame
from gridframe.plans.index import block_of, part_of
from gridframe.plans.layout import GridLayout, cuts_at


def redistribute(a: GridFrame, layout: GridLayout) -> GridFrame:
    """The same values under another layout. Nothing moves before the frame is
    placed: a layout is a plan, and Spark's partitioning needn't follow it."""
    if layout.shape != a.shape:
        raise ValueError(f"Shapes must match: {a.shape} and {layout.shape}")
    return a.like(a.value, layout=layout)


def placed(a: GridFrame) -> DataFrame:
    """i0, ..., v and block, with each block in the partition of its number."""
    rows = a.df.withColumn("block", block_of([F.col(i) for i in a.index], a.layout))
    return rows.repartitionById(a.layout.n_blocks, F.col("block").cast("int"))


#: Sums that the driver receives in one round of the search for cuts, at most.
SEARCHED = 4096


def searched_cuts(weights: GridFrame, axis: int, n: int, least: int = 1) -> tuple[int, ...]:
    """weighted_cuts() of the weights' sums along an axis, which stay on the executors.

    Shares are searched for all at once: the stretch of cells that reaches each is cut
    into as many parts as SEARCHED allows, whose sums decide where to look on, until the
    stretches are single cells."""
    length, i = weights.shape[axis], F.col(f"i{axis}")
    rows = weights.base.select(i.alias("i"), weights.value.alias("w"))
    exact = weights.dtype.kind in "iub"
    rows = rows.select("i", F.col("w").cast("int").cast("long").alias("w") if weights.dtype.kind == "b" else F.col("w").cast("long" if exact else "double").alias("w"))
    total, worst = rows.agg(F.coalesce(F.sum("w"), F.lit(0)), F.min(F.when((F.col("w") >= 0) & (F.col("w").cast("double") < float("inf")), 0).otherwise(-1))).first()
    if worst == -1:
        raise ValueError("weights must be finite and not negative")
    shares = [total * k / n for k in range(1, n)]
    at = [(0, length, 0)] * len(shares)  # of each share: the stretch that reaches it, and the weight before
    after = [total] * len(shares)
    while total > 0 and any(high - low > 1 for low, high, _ in at):
        stretches = sorted({(low, high) for low, high, _ in at if high - low > 1})
        parts = max(2, SEARCHED // len(stretches))
        number, inside = F.lit(None).cast("long"), F.lit(False)
        steps = {}
        for s, (low, high) in enumerate(stretches):
            steps[low, high] = step = -(-(high - low) // parts)
            own = F.col("i").between(low, high - 1)
            number, inside = F.when(own, F.lit(s * (parts + 1)) + F.call_function("div", F.col("i") - F.lit(low), F.lit(step))).otherwise(number), inside | own
        sums = dict(rows.where(inside).groupBy(number.alias("part")).agg(F.sum("w")).collect())
        for k, (low, high, before) in enumerate(at):
            if high - low <= 1:
                continue
            s, step = stretches.index((low, high)), steps[low, high]
            last = -(-(high - low) // step) - 1
            for part in range(last + 1):
                own = sums.get(s * (parts + 1) + part, 0)
                if before + own >= shares[k] or part == last:
                    break
                before += own
            at[k], after[k] = (low + part * step, min(high, low + (part + 1) * step), before), before + own
    return cuts_at([(low, before, done) for (low, _, before), done in zip(at, after)], total, length, n, least)


def rebalance(a: GridFrame, weights: GridFrame) -> GridFrame:
    """a under a layout whose blocks carry near-equal weight."""
    if weights.shape != a.shape:
        raise ValueError("Shapes must match")
    layout = a.layout
    bounds = [searched_cuts(weights, k, p, max(1, h)) if p > 1 else cuts for k, (p, h, cuts) in enumerate(zip(layout.grid, layout.halo, layout.bounds))]
    return redistribute(a, GridLayout(layout.shape, split=layout.split, bounds=tuple(bounds), **layout.options()))


def owner_column(layout: GridLayout, index: Sequence[Column], clip: bool = False) -> Column:
    """The owning block of an index; with clip, of the nearest cell."""
    if clip:
        index = [F.greatest(F.lit(0).cast("long"), F.least(i, F.lit(n - 1).cast("long"))) for i, n in zip(index, layout.shape)]
    return block_of(index, layout)


def numbering_column(layout: GridLayout, index: Sequence[Column]) -> Column:
    """A cell's position when blocks are stored one after another: the cells of all
    blocks before its own, which factor by axis, and its place within the block."""
    at = F.lit(0).cast("long")
    parts = [part_of(i, b) for i, b in zip(index, layout.bounds)]
    starts = [pick(p, [c for c in b[:-1]]) for p, b in zip(parts, layout.bounds)]
    lengths = [pick(p, [y - x for x, y in zip(b, b[1:])]) for p, b in zip(parts, layout.bounds)]
    # Cells before the block: along axis k, whole slabs of the axes after it, within
    # this block's extent along the axes before it.
    for k in range(layout.ndim):
        slab = starts[k]
        for n in layout.shape[k + 1 :]:
            slab = slab * F.lit(n)
        for j in range(k):
            slab = slab * lengths[j]
        at = at + slab
    inside = F.lit(0).cast("long")
    for i, s, n in zip(index, starts, lengths):
        inside = inside * n + (i - s)
    return at + inside


def pick(part: Column, values: Sequence[int]) -> Column:
    """values[part], without a chain where the values are evenly spaced."""
    step = values[1] - values[0] if len(values) > 1 else 0
    if all(v == values[0] + k * step for k, v in enumerate(values)):
        return F.lit(values[0]).cast("long") + part * F.lit(step)
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (part + 1).cast("int"))


def block_numbering(a: GridFrame) -> GridFrame:
    return a.like(numbering_column(a.layout, [F.col(i) for i in a.index]), dtype="int64", unit=None)


def migrate(rows: DataFrame, dest: str | Column, n_blocks: int, source: str, order: str) -> DataFrame:
    """rows in the partition of their destination, by source and original order.

    Destinations outside of the blocks raise when the rows are computed."""
    dest = F.col(dest) if isinstance(dest, str) else dest
    checked = F.when(dest.between(0, n_blocks - 1), dest.cast("int")).otherwise(F.raise_error(F.lit(f"a destination outside of {n_blocks} blocks")).cast("int"))
    return rows.withColumn("dest", checked).repartitionById(n_blocks, F.col("dest")).sortWithinPartitions("dest", source, order)


def deposit(rows: DataFrame, cells: Sequence[Column], weight: Column, shape: Sequence[int]) -> DataFrame:
    """Sums of particle weights by nearest cell: i0, ..., v, for cells with particles."""
    return rows.select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(cells)], weight.alias("w")).groupBy(*[f"i{k}" for k in range(len(shape))]).agg(F.sum("w").alias("v"))


def deposit_cloud(rows: DataFrame, positions: Sequence[Column], weight: Column, shape: Sequence[int], periodic: bool = True) -> DataFrame:
    """Cloud-in-cell deposition: each particle's weight is shared by the 2^n cells
    around it, by distance. Positions are in units of cells."""
    lows = [F.floor(p).cast("long") for p in positions]
    rest = [p - F.floor(p) for p in positions]
    corners = []
    for corner in range(2 ** len(shape)):
        index, share = [], weight
        for k, n in enumerate(shape):
            up = corner >> k & 1
            i = lows[k] + F.lit(up)
            index.append((F.pmod(i, F.lit(n)) if periodic else i).alias(f"i{k}"))
            share = share * (rest[k] if up else 1 - rest[k])
        corners.append(F.struct(*index, share.alias("w")))
    spread = rows.select(F.explode(F.array(*corners)).alias("c")).select("c.*")
    if not periodic:
        inside = F.lit(True)
        for k, n in enumerate(shape):
            inside = inside & F.col(f"i{k}").between(0, n - 1)
        spread = spread.where(inside)
    return spread.groupBy(*[f"i{k}" for k in range(len(shape))]).agg(F.sum("w").alias("v"))



