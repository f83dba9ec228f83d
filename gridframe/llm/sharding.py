"""Sharding by histogram sort.

Rows are ordered by a key of their text and, within equal texts, by id. The
splitters between shards lie where the running bytes come nearest to equal
shares. They are found by counting, not by sorting: every round counts, over all
partitions at once, the exact bytes below a few candidate keys in each open
bracket, and keeps the bracket that holds the share's boundary; a bracket that
holds a single key is closed. Only then rows are exchanged, once, each to its
range.

Equal texts stay in one shard, and its boundary moves to the nearer side of
them, as long as they hold no more than `group_share` of a shard's bytes. A
larger group is cut between ids by the same rounds on the id, so that a text
which makes up a third of all rows can't fill a shard beyond its share.

Scale: a round moves one row for each candidate and task, whatever the row
count; brackets shrink to keys that occur, by a factor of PROBES + 1 or more, so
the number of rounds grows with the logarithm of the row count. Each shard is
exchanged as `ranges` ranges with splitters of their own, so that no task holds
a whole shard; slots are gapless by adding the ranges' counted rows. Splitters and
candidates, PROBES + 2 for each, travel with the tasks: one splitter for every
`rows_per_range` rows, some megabytes at 10^11 rows.

Cases: a null text counts no bytes (every row has 16 besides) and is keyed as an
empty one; repeated rows are all kept, those equal in text and id side by side;
a null id sorts first; an empty table gives no rows; fewer rows than shards leave
shards empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import cut, small_side

PROBES = 8
OVERHEAD = 16


def shard_keys(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """__key (60 bits of the text's md5), __id, __size and __crc of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("long").alias("__key"),
        F.col(id_col).cast("long").alias("__id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("__size"),
        F.crc32(body).alias("__crc"),
    )


def count_bins(rows: DataFrame, column: str, probes: dict[int, np.ndarray], hot: bool) -> list:
    """(segment, bin, bytes, lowest, highest) of `column`, bin i being the rows
    from probe i - 1 up to below probe i. Segments are keys when hot, else 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            values, sizes = batch.column("v").to_numpy(), batch.column("n").to_numpy()
            keys = batch.column("k").to_numpy()
            for segment, edges in probes.items():
                at = np.flatnonzero(keys == segment) if hot else slice(None)
                v, n = values[at], sizes[at]
                if not len(v):
                    continue
                bins = np.searchsorted(edges, v, side="right")
                order = np.argsort(bins, kind="stable")
                v, n, bins = v[order], n[order], bins[order]
                first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
                for b, s, lo, hi in zip(bins[first].tolist(), np.add.reduceat(n, first).tolist(), np.minimum.reduceat(v, first).tolist(), np.maximum.reduceat(v, first).tolist()):
                    x = held.setdefault((segment, b), [0, lo, hi])
                    x[0], x[1], x[2] = x[0] + s, min(x[1], lo), max(x[2], hi)
        out = [(s, b, *x) for (s, b), x in held.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["s", "b", "n", "lo", "hi"])

    rows = rows.select(F.col("__key").alias("k"), F.coalesce(F.col(column), F.lit(int(np.iinfo(np.int64).min))).alias("v"), F.col("__size").alias("n"))
    if hot:
        rows = rows.where(F.col("k").isin([int(k) for k in probes]))
    parts = rows.mapInArrow(count, "s long, b long, n long, lo long, hi long")
    return parts.groupBy("s", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("s", "b").collect()


def find_items(rows: DataFrame, column: str, targets: dict[int, list[tuple[float, int]]], base: dict[int, int], hot: bool) -> dict[int, dict[int, tuple[int, int, int]]]:
    """For each segment and target (position, number): the value of `column`
    whose rows the position falls into, the bytes below it and its own bytes."""
    found: dict[int, dict[int, tuple[int, int, int]]] = {s: {} for s in targets}
    span = (np.iinfo(np.int64).min, np.iinfo(np.int64).max)
    brackets = {s: {j: span if hot else (0, 2**60) for _, j in t} for s, t in targets.items()}
    while any(brackets.values()):
        probes = {}
        for s, open_ in brackets.items():
            edges = set()
            for lo, hi in set(open_.values()):
                step = max(1, (int(hi) - int(lo)) // (PROBES + 1))
                edges.update(range(int(lo), int(hi) + 1, step) if step > 1 or hi - lo <= PROBES + 1 else [])
                edges.add(int(hi))
            if edges:
                probes[s] = np.array(sorted(edges), np.int64)
        counted: dict[int, list] = {s: [] for s in probes}
        for r in count_bins(rows, column, probes, hot):
            counted[r["s"]].append(r)
        for s, bins in counted.items():
            ends = base[s] + np.cumsum([r["n"] for r in bins])
            for position, j in [t for t in targets[s] if t[1] in brackets[s]]:
                i = min(int(np.searchsorted(ends, position, side="right")), len(bins) - 1)
                r = bins[i]
                if r["lo"] == r["hi"]:
                    found[s][j] = (r["lo"], int(ends[i]) - r["n"], r["n"])
                    del brackets[s][j]
                else:
                    brackets[s][j] = (r["lo"], r["hi"])
    return found


def splitters(rows: DataFrame, total: int, n_shards: int, ranges: int, group_share: float) -> list[tuple[int, int]]:
    """The (key, id) that each range after the first begins with."""
    n = n_shards * ranges
    lowest = np.iinfo(np.int64).min
    near = find_items(rows, "__key", {0: [(total * j / n, j) for j in range(1, n)]}, {0: 0}, False)[0]
    out: dict[int, tuple[int, int]] = {}
    inside: dict[int, list[tuple[float, int]]] = {}
    base: dict[int, int] = {}
    for j, (key, below, size) in near.items():
        if size > group_share * total / n_shards:
            inside.setdefault(key, []).append((total * j / n, j))
            base[key] = below
        else:
            out[j] = (key, lowest) if n * (2 * below + size) >= 2 * total * j else (key + 1, lowest)
    if inside:
        for key, items in find_items(rows, "__id", inside, base, True).items():
            for j, (value, below, size) in items.items():
                out[j] = (key, value) if n * (2 * below + size) >= 2 * total * j else (key, value + 1)
    return [out[j] for j in range(1, n)]


def histogram_shards(docs: DataFrame, n_shards: int = 40, text: str = "text", id_col: str = "doc_id", group_share: float = 0.05, rows_per_range: int = 250_000) -> DataFrame:
    """id_col, __size, __crc, __shard and __slot of each row of docs."""
    rows = cut(shard_keys(docs, text, id_col))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("__size"), F.lit(0))).first()
    ranges = max(4, -(-count // (n_shards * rows_per_range)))
    edges = splitters(rows, total, n_shards, ranges, group_share) if count else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = np.array(edges, np.int64).reshape(-1, 2).T
        for batch in batches:
            k, i = batch.column("__key").to_numpy(), batch.column("__id").fill_null(np.iinfo(np.int64).min).to_numpy()
            at = np.searchsorted(keys, k, side="left")
            end = np.searchsorted(keys, k, side="right")
            some = np.flatnonzero(at < end)  # rows of a key at which ranges begin: compare ids
            for key in np.unique(k[some]):
                rows_ = some[k[some] == key]
                lo, hi = at[rows_[0]], end[rows_[0]]
                at[rows_] = lo + np.searchsorted(ids[lo:hi], i[rows_], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "__part"])

    placed = rows.mapInArrow(place, "__key long, __id long, __size long, __crc long, __part int")
    within = Window.partitionBy("__part").orderBy("__key", "__id")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    shard = F.floor(F.col("__part") / F.lit(ranges)).cast("int")
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__shard", shard).select(F.col("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = placed.withColumn("__at", F.row_number().over(within)).join(small_side(offsets, n_shards * ranges), "__part")
    return numbered.select(F.col("__id").alias(id_col), "__size", "__crc", shard.alias("__shard"), (F.col("__before") + F.col("__at") - 1).alias("__slot"))
