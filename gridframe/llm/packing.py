"""Packing documents into windows of tokens by non-negative least squares.

Documents are cut at every full window; what remains of each is a piece of a
length below the window. All planning happens on the histogram of those lengths,
of fewer bins than a window has tokens, whatever the row count: combinations of
lengths that fill a window exactly are enumerated, repeat counts that best explain
the histogram are solved under non-negativity and rounded, what is left is solved
again, and the few pieces then left over are packed largest first.
Each piece then reads its sequence and offset from the plan by its number among
the pieces of its length.

Scale: texts are tokenised once, in Arrow batches, into a narrow table of pieces
that is kept in the shared folder. Numbers within a length are two-level (a hash
range for every ROWS_A_RANGE pieces of it, counted first), so a length that a third
of all pieces share is no hot key. The plan has a few rows a length and travels
with the tasks.

Cases: a null or empty text is the end id alone; repeated rows are packed each;
texts of any length are cut into as many windows as they need; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import cut, slices
from gridframe.llm.tokens import encoder

ROWS_A_RANGE = 100_000
KEPT_PIECES = 400_000
#: A pair fills the rest where both its lengths are as plentiful as this share of the
#: commonest length that fits.
PLENTIFUL = 0.25
SWEEPS, PASSES = 200, 30


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """__id, __start, __length, __crc and __tokens (the document's) of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, KEPT_PIECES)
        for part in slices(batches, ["__id", "__text"], text="__text"):
            rows = []
            for i, ids in zip(part["__id"], encode.ids([t or "" for t in part["__text"]])):
                ids += end
                n = len(ids) // 4
                rows += [(i, at, min(window, n - at), zlib.crc32(ids[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["__id", "__start", "__length", "__crc", "__tokens"])

    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    return named.mapInArrow(run, "__id long, __start long, __length long, __crc long, __tokens long")


def combinations(histogram: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Combinations of lengths that fill the window exactly.

    From the longest length on, each gets a combination with what is most plentiful then:
    pieces of the commonest lengths, until one length or a pair of them fills the rest.
    A combination counts as used until one of its lengths is spent, so there are no more
    of them than lengths, whatever the number of pieces that a window needs."""
    left = np.zeros(window + 1)
    for k, n in histogram.items():
        left[k] = n
    found = []
    for a in sorted((k for k in histogram if k <= window), reverse=True):
        while left[a] > 1e-9:
            own, rest = Counter([a]), window - a
            spare = left.copy()
            spare[a] -= 1e-9 if left[a] <= 1 else 1
            while rest:
                if spare[rest] > 1e-9:
                    own[rest] += 1
                    break
                most = int(np.argmax(spare[: rest + 1]))
                if spare[most] <= 1e-9:
                    own = None
                    break
                b = np.arange(1, rest // 2 + 1)
                both = np.minimum(spare[b], spare[rest - b])
                at = int(np.argmax(both)) if len(b) else 0
                if len(b) and both[at] > 1e-9 and both[at] >= PLENTIFUL * spare[most]:
                    own.update((int(b[at]), rest - int(b[at])))
                    break
                own[most] += 1
                rest -= most
                spare[most] /= 2  # so that a combination holds several lengths
            if own is None:
                break
            n = min(left[k] / m for k, m in own.items())
            for k, m in own.items():
                left[k] = max(0.0, left[k] - m * n)
            found.append(tuple(sorted(own.elements(), reverse=True)))
    return found


def solve(histogram: dict[int, int], columns: list[tuple[int, ...]]) -> list[float]:
    """x >= 0 that minimises |A x - h|, by cyclic coordinate descent; A's columns count
    the lengths of a combination."""
    left = {k: float(v) for k, v in histogram.items()}
    made = [tuple(Counter(c).items()) for c in columns]
    weight = [sum(m * m for _, m in c) for c in made]
    x = [0.0] * len(columns)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, c in enumerate(made):
            step = max(-x[j], sum(m * left[k] for k, m in c) / weight[j])
            if step:
                x[j] += step
                moved += abs(step)
                for k, m in c:
                    left[k] -= m * step
        if moved <= 1e-6 * sum(x):
            break
    return x


def solved(histogram: dict[int, int], window: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(lengths, repeats) of the solved combinations, and what they leave of the histogram.

    Repeats are rounded so that their running sum stays next to that of the solution, as
    far as there are pieces. What is left is solved again, as long as that places some."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    for _ in range(PASSES):
        columns = combinations(left, window)
        sum_, taken, placed_ = 0.0, 0, 0
        for x, c in zip(solve(left, columns), columns):
            need = Counter(c)
            sum_ += x
            n = min(round(sum_) - taken, *(left[k] // m for k, m in need.items()))
            if n > 0:
                taken += n
                placed_ += n
                out.append((c, n))
                for k, m in need.items():
                    left[k] -= m * n
        left = {k: v for k, v in left.items() if v}
        if not placed_:
            break
    return out, left


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up the histogram, each within the window."""
    out, left = solved(histogram, window)
    lengths = sorted(left, reverse=True)
    while lengths:  # largest first, each time as often as its lengths last
        room, need = window, Counter()
        for k in lengths:
            if room < lengths[-1]:
                break
            m = min(left[k], room // k)
            if m:
                need[k], room = m, room - m * k
        n = min(left[k] // m for k, m in need.items())
        out.append((tuple(need.elements()), n))
        for k, m in need.items():
            left[k] -= m * n
        lengths = [k for k in lengths if left[k]]
    return out


def placed(rows: DataFrame, made: list[tuple[tuple[int, ...], int]], histogram: dict[int, int]) -> DataFrame:
    """rows(__id, __start, __length, __crc, __tokens) with __sequence and __offset."""
    spans, used, sequence = [], Counter(), 0
    for lengths, n in made:
        offset = 0
        for k in lengths:
            spans.append((k, used[k], sequence, offset))
            used[k] += n
            offset += k
        sequence += n
    spans.sort()
    big = 2**48
    starts, firsts, sequences, offsets = (np.array(c, np.int64) for c in ([k * big + a for k, a, _, _ in spans], [a for _, a, _, _ in spans], [s for _, _, s, _ in spans], [o for _, _, _, o in spans]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("__number").to_numpy()
            at = np.searchsorted(starts, batch.column("__length").to_numpy() * big + number, side="right") - 1
            own = [batch.column(c) for c in ("__id", "__start", "__length", "__crc", "__tokens")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequences[at] + number - firsts[at]), pa.array(offsets[at])], names=["__id", "__start", "__length", "__crc", "__tokens", "__sequence", "__offset"])

    several = {k: -(-n // ROWS_A_RANGE) for k, n in histogram.items() if n > ROWS_A_RANGE}
    ranges = F.coalesce(F.create_map(*[F.lit(x) for kn in several.items() for x in kn])[F.col("__length")], F.lit(1)) if several else F.lit(1)
    ranged = rows.withColumn("__range", F.pmod(F.xxhash64("__id", "__start"), ranges).cast("int"))
    sizes = ranged.groupBy("__length", "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__length").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__length", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__length", "__range").orderBy("__id", "__start", "__crc")
    numbered = ranged.withColumn("__at", F.row_number().over(within)).join(sizes, ["__length", "__range"])
    numbered = numbered.select("__id", "__start", "__length", "__crc", "__tokens", (F.col("__before") + F.col("__at") - 1).alias("__number"))
    return numbered.mapInArrow(look_up, "__id long, __start long, __length long, __crc long, __tokens long, __sequence long, __offset long")


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = cut(pieces(docs, tokenizer, window, end_id, id_col, text))
    histogram = {r["__length"]: r["n"] for r in rows.groupBy("__length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    return placed(rows, plan(histogram, window), histogram).select(
        F.col("__id").alias(id_col), F.col("__start").alias("start"), F.col("__length").alias("length"), F.col("__crc").alias("ids_crc32"),
        F.col("__tokens").alias("doc_tokens"), F.col("__sequence").alias("sequence_id"), F.col("__offset").alias("offset"),
    )
