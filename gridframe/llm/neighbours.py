"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cell floor((a.x + b) / width) of a few Gaussian
projections. A query visits, in each table, its own cell and then those beside
it in the order of how likely they hold near vectors: by the summed squares of
its distances to the borders that must be crossed. What the visited cells of all
tables hold is ranked by the exact inner product in double precision, and the
tables' findings are merged. Largest inner products become least distances by
one more coordinate that brings stored vectors to one length: that of the longest
in their range of norms (half an octave each), so that one long vector doesn't
press all others into a few cells. Every range has cells of its own.

How many projections, how wide a cell and how many cells to visit is fitted to a
recall target: SAMPLE_QUERIES queries, those whose hashed ids are least, are
ranked against all rows; for every choice the least number of visits that finds
`recall` of their true neighbours is taken, and of the choices the one that visits
the smallest share of SAMPLE_ROWS rows. With more rows the nearest are nearer and
a smaller share of cells is enough.

Queries that find fewer than k go on to all rows, in blocks.

Scale: equal vectors are one class, with its smallest ids (no more can be among
the nearest), so that one common vector is one stored row. Cells are dealt into
groups of about BLOCK stored vectors, a cell of more into as many; a query goes
once to each group that holds some of its cells, with the list of them. A task
holds one group and its queries; only each group's best go on.

Cases: null and zero vectors, and those that hold null or non-finite components
or are of another length than most, take no part; vectors of any other length
do, as lengths are taken of scaled components; a score beyond a double's range is
infinite; a repeated id counts once; ties go to the smaller id; fewer candidates
than k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import cut, hot_keys, spread_join

TABLES, RECALL = 4, 0.95
PROJECTIONS, WIDTHS = (3, 4, 5, 6), (1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 1e9)  # the last: one cell
SAMPLE_QUERIES, SAMPLE_ROWS = 64, 4096
BLOCK, SALTS = 4096, 64
REST_BLOCK, REST_QUERIES, RANGES = 32_768, 65_536, 64


def vectors_of(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, dims)


def lengths(x: np.ndarray) -> np.ndarray:
    """The norms of vectors that aren't zero, however small or large."""
    most = np.abs(x).max(axis=1)
    y = x / most[:, None]
    return most * np.sqrt((y * y).sum(axis=1))


def valid_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, f1 and f2 (128 bits of the vector), dims, norm and x (doubles) of valid rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, known = batch.column("v"), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            flat = v.values.cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False) + 0.0  # nulls are NaN; no negative zeros
            starts, ends = v.offsets.to_numpy()[:-1], v.offsets.to_numpy()[1:]
            spoilt, filled = (np.r_[0, np.cumsum(c)] for c in (~np.isfinite(x), x != 0))
            some = np.flatnonzero(known & v.is_valid().to_numpy(zero_copy_only=False) & (spoilt[ends] == spoilt[starts]) & (filled[ends] > filled[starts]))
            if not len(some):
                continue
            dims, norms = (ends - starts)[some], np.zeros(len(some))
            for n in np.unique(dims):
                own = np.flatnonzero(dims == n)
                norms[own] = lengths(x[starts[some[own]][:, None] + np.arange(n)])
            raw = [x[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            prints = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), "<i8").reshape(-1, 2)
            columns = [batch.column("id").take(pa.array(some)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(dims, pa.int32()), pa.array(norms), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "f1", "f2", "dims", "norm", "x"])

    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    return named.mapInArrow(run, "id long, f1 long, f2 long, dims int, norm double, x binary")


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """f1, f2, rep and ids (the `keep` smallest) of each class of equal vectors."""
    part = Window.partitionBy("f1", "f2", "salt").orderBy("id")
    whole = Window.partitionBy("f1", "f2").orderBy("id")
    few = rows.select("f1", "f2", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).distinct()
    few = few.withColumn("at", F.row_number().over(part)).where(F.col("at") <= keep)
    few = few.withColumn("at", F.row_number().over(whole)).where(F.col("at") <= keep)
    return few.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))


@dataclass
class Tables:
    """The hash tables' projections, the same at every run."""

    dims: int
    tables: int
    projections: int
    width: float
    seed: int
    probes: int = 0

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.directions = rng.normal(size=(self.tables, self.dims + 1, self.projections)) / self.width
        self.shifts = rng.uniform(size=(self.tables, 1, self.projections))
        self.steps = np.array(sorted(itertools.product((-1, 0, 1), repeat=self.projections), key=lambda s: (sum(map(abs, s)), s)))
        self.place = np.int64(1024) ** np.arange(self.projections)

    def codes(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        at = x @ self.directions[table] + self.shifts[table]
        cell = np.floor(at)
        return (np.clip(cell, -500, 500).astype(np.int64) + 512) @ self.place, at - cell

    def visits(self, x: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """The cells that each query visits, likeliest first."""
        own, inside = self.codes(x, table)
        low, high = inside**2 @ (self.steps == -1).T, (1 - inside) ** 2 @ (self.steps == 1).T
        order = np.argsort(low + high, axis=1, kind="stable")[:, : probes or self.probes]
        return own[:, None] + (self.steps @ self.place)[order]


def stored(x: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Vectors as the tables see them: no longer than 1 (`longest`: that of each one's range)."""
    y = x / longest[:, None]
    return np.c_[y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))]


def asked(x: np.ndarray) -> np.ndarray:
    y = x / np.abs(x).max(axis=1)[:, None]
    return np.c_[y / np.sqrt((y * y).sum(1))[:, None], np.zeros(len(x))]


def fitted(dims: int, tables: int, seed: int, recall: float, queries: np.ndarray, pairs: list[tuple[int, int]], near: np.ndarray, sample: np.ndarray) -> Tables:
    """The tables that find `recall` of the pairs (query, row of near) while visiting
    the smallest share of the sample. near and sample are as stored() gives them."""
    if not len(queries):
        return Tables(dims, tables, PROJECTIONS[0], WIDTHS[0], seed, probes=1)
    best = None
    asked_by, found = (np.array(c, int) for c in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    for projections, width in itertools.product(PROJECTIONS, WIDTHS):
        made = Tables(dims, tables, projections, width, seed)
        rank = np.full(len(pairs), len(made.steps))
        visits = []
        for t in range(tables):
            own = made.visits(queries, t, len(made.steps))
            visits.append(own)
            match = own[asked_by] == made.codes(near, t)[0][found][:, None]
            rank = np.minimum(rank, np.where(match.any(axis=1), match.argmax(axis=1), len(made.steps)))
        need = int(np.ceil(recall * len(pairs)))
        made.probes = int(np.sort(rank)[need - 1]) + 1 if need else 1
        if made.probes > len(made.steps):
            continue
        seen = np.zeros((len(queries), len(sample)), bool)
        for t in range(tables):
            codes = made.codes(sample, t)[0]
            for i in range(len(queries)):
                seen[i] |= np.isin(codes, visits[t][i, : made.probes])
        share = (seen.mean(), made.probes)
        if best is None or share < best[0]:
            best = (share, made)
    return best[1]


def group_of(codes: np.ndarray, groups: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups


def range_of(norms: np.ndarray, longest: float) -> np.ndarray:
    """The range of norms, each half an octave wide, the last without an end."""
    return np.clip(np.floor(2 * (np.log2(longest) - np.log2(norms))), 0, RANGES - 1).astype(np.int64)


def best_in_group(codes: np.ndarray, reps: np.ndarray, x: np.ndarray, queries: np.ndarray, cells: list[np.ndarray], k: int) -> list[tuple[list[int], list[float]]]:
    """For each query the k best of the stored vectors whose codes it visits."""
    order = np.argsort(codes, kind="stable")
    codes, reps, x = codes[order], reps[order], x[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    spans = dict(zip(codes[starts].tolist(), zip(starts.tolist(), np.r_[starts[1:], len(codes)].tolist())))
    askers: dict[int, list[int]] = {}
    for i, own in enumerate(cells):
        for c in own.tolist():
            if c in spans:
                askers.setdefault(c, []).append(i)
    score = np.full((len(queries), len(x)), -np.inf)
    for c, rows in askers.items():
        a, b = spans[c]
        score[rows, a:b] = queries[rows] @ x[a:b].T
    out = []
    for i, row in enumerate(score):
        found = np.flatnonzero(row > -np.inf)
        if len(found) > k:  # products of a matrix may differ in the last bits: take all near the k-th, then rank exactly
            least = np.partition(row[found], len(found) - k)[len(found) - k]
            found = found[row[found] >= least - 1e-9 * max(1.0, abs(least))]
        exact = (x[found] * queries[i]).sum(axis=1)
        best = np.lexsort((reps[found], -exact))[:k]
        out.append((reps[found][best].tolist(), exact[best].tolist()))
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", tables: int = TABLES, recall: float = RECALL, seed: int = 0) -> DataFrame:
    """query_id, rank, id_col and score: the k nearest found of each row for which
    is_query (of id_col) holds, itself left out."""
    rows = cut(valid_vectors(vectors, id_col, vector))
    most = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy(F.col("n").desc(), "dims").first()
    out_schema = f"query_id long, rank int, `{id_col}` long, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], out_schema)
    dims, longest = most["dims"], most["longest"]
    rows = rows.where(F.col("dims") == dims)
    classes = cut(classes_of(rows, k + 1))
    base = cut(rows.join(classes.select(F.col("rep").alias("id"), F.col("f1").alias("c1"), F.col("f2").alias("c2")), "id").where((F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2"))).select("id", "x").dropDuplicates(["id"]))
    asking = rows.select(F.col("id").alias(id_col), "f1", "f2").where(is_query).select(F.col(id_col).alias("query_id"), "f1", "f2").distinct()
    alike = cut(asking.groupBy("f1", "f2").agg(F.count("*").alias("n")))
    asking = cut(spread_join(asking, classes.select("f1", "f2", "rep"), ["f1", "f2"], hot_keys(alike, "f1", "n"), ["query_id"]).select("query_id", "rep"))
    query_vectors = cut(base.join(asking.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))

    def count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = lengths(vectors_of(batch.column("x"), dims))
            yield pa.RecordBatch.from_arrays([pa.array(range_of(norms, longest)), pa.array(norms)], names=["r", "norm"])

    ranges = base.select("x").mapInArrow(count_ranges, "r long, norm double").groupBy("r").agg(F.max("norm").alias("most")).collect()  # RANGES rows at most
    reach = np.ones(RANGES)
    for r in ranges:
        reach[r["r"]] = r["most"]
    present = sorted(r["r"] for r in ranges)

    def as_stored(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors as stored, and their ranges of norms."""
        r = range_of(lengths(x), longest)
        return stored(x, reach[r]), r

    hashing = fitted(dims, tables, seed, recall, *calibration(base, query_vectors, dims, k, as_stored))

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, r = as_stored(vectors_of(batch.column("x"), dims))
            for t in range(tables):
                codes, n = np.unique(hashing.codes(x, t)[0] * RANGES + r, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t)), pa.array(codes), pa.array(n)], names=["t", "code", "n"])

    cells = base.select("x").mapInArrow(count_cells, "t long, code long, n long").groupBy("t", "code").agg(F.sum("n").alias("n"))
    largest, total = cells.agg(F.max("n"), F.sum("n")).first()
    salts = -(-largest // BLOCK)
    groups = max(1, -(-total // (tables * BLOCK * salts)))

    def deal_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            x, r = as_stored(vectors_of(batch.column("x"), dims))
            for t in range(tables):
                codes = hashing.codes(x, t)[0] * RANGES + r
                g = group_of(codes, groups) * salts + group_of(ids * 2 + 1, salts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1), pa.int32()), pa.array(codes))
                yield deal_batch(t, g, 0, ids, lists, batch.column("x"))

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column("id").to_numpy(), batch.column("x")
            x = asked(vectors_of(raw, dims))
            for t in range(tables):
                visits = (hashing.visits(x, t)[:, :, None] * RANGES + np.array(present)).reshape(len(x), -1)
                row, where = np.repeat(np.arange(len(x)), visits.shape[1]), group_of(visits, groups).ravel()
                order = np.lexsort((row, where))
                row, where, codes = row[order], where[order], visits.ravel()[order]
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (where[1:] != where[:-1])])
                ends = np.r_[starts[1:], len(row)]
                for at in range(0, len(starts), 4096):  # a row for each query and group
                    own, to = starts[at : at + 4096], ends[at : at + 4096]
                    offsets = np.r_[own, to[-1]] - own[0]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes[own[0] : to[-1]]))
                    for s in range(salts):
                        yield deal_batch(t, where[own] * salts + s, 1, ids[row[own]], lists, raw.take(pa.array(row[own])))

    kinds = "t long, g long, role int, id long, codes array<long>, x binary"
    dealt = base.mapInArrow(deal_base, kinds).union(query_vectors.mapInArrow(deal_queries, kinds))
    dealt = dealt.repartition("t", "g").sortWithinPartitions("t", "g", "role")

    def rank_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            t, g, role, ids = (batch.column(c).to_numpy() for c in ("t", "g", "role", "id"))
            codes, x = batch.column("codes").to_pylist(), vectors_of(batch.column("x"), dims)
            key = np.stack([t, g, role], 1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            for a, b in zip(starts.tolist(), np.r_[starts[1:], len(t)].tolist()):
                if group != (t[a], g[a]):
                    group, held, ready = (t[a], g[a]), [], None
                if role[a] == 0:
                    held.append((np.array([c[0] for c in codes[a:b]], np.int64), ids[a:b].copy(), x[a:b].copy()))
                    continue
                if not held:
                    continue
                ready = ready or tuple(np.concatenate(c) for c in zip(*held))
                for lo in range(a, b, 256):
                    hi = min(b, lo + 256)
                    best = best_in_group(*ready, x[lo:hi], [np.array(c, np.int64) for c in codes[lo:hi]], k + 1)
                    some = [i for i, (r, _) in enumerate(best) if r]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi][some], pa.int64()), pa.array([best[i][0] for i in some], pa.list_(pa.int64())), pa.array([best[i][1] for i in some], pa.list_(pa.float64()))],
                        names=["asker", "reps", "scores"],
                    )

    lists = "asker long, reps array<long>, scores array<double>"
    found = dealt.mapInArrow(rank_groups, lists)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker, best = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if best:
                top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[: k + 1]
                yield pa.RecordBatch.from_arrays([pa.array([asker] * len(top), pa.int64()), pa.array([r for r, _ in top], pa.int64()), pa.array([s for _, s in top], pa.float64())], names=["asker", "rep", "score"])

        for batch in batches:
            for a, reps, scores in zip(*(c.to_pylist() for c in batch.columns)):
                if a != asker:
                    yield from done()
                    asker, best = a, {}
                best.update(zip(reps, scores))
        yield from done()

    def merged_of(found: DataFrame) -> DataFrame:
        return found.repartition("asker").sortWithinPartitions("asker").mapInArrow(merge, "asker long, rep long, score double")

    # Queries that found fewer than k go on to all rows, in blocks.
    merged = cut(merged_of(found))
    enough = merged.groupBy("asker").agg(F.count("*").alias("n")).where(F.col("n") > k).select(F.col("asker").alias("id"))
    short = cut(query_vectors.join(enough, "id", "left_anti"))
    n_short, n_base = short.count(), base.count()
    slices, blocks = max(1, -(-n_short // REST_QUERIES)), max(1, -(-n_base // REST_BLOCK))

    def deal_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column("id").to_numpy(), batch.column("x")
            for t in range(slices):
                yield deal_batch(t, group_of(ids * 2 + 1, blocks), 0, ids, one_cell(len(ids)), raw)

    def deal_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column("id").to_numpy(), batch.column("x")
            slice_ = group_of(ids * 2 + 1, slices)
            for t in range(slices):
                some = np.flatnonzero(slice_ == t)
                for g in range(blocks if len(some) else 0):
                    yield deal_batch(t, np.full(len(some), g), 1, ids[some], one_cell(len(some)), raw.take(pa.array(some)))

    if n_short:
        rest = base.mapInArrow(deal_rest, kinds).union(short.mapInArrow(deal_short, kinds))
        more = rest.repartition("t", "g").sortWithinPartitions("t", "g", "role").mapInArrow(rank_groups, lists)
        merged = merged_of(more.union(merged.select("asker", F.array("rep").alias("reps"), F.array("score").alias("scores"))))
    spread = merged.join(classes.select("rep", "ids"), "rep").select(F.col("asker"), F.explode("ids").alias(id_col), "score")
    by_rep = cut(asking.groupBy("rep").agg(F.count("*").alias("n")))
    near = spread_join(asking.withColumnRenamed("rep", "asker"), spread, ["asker"], hot_keys(by_rep, "rep", "n"), ["query_id"]).where(F.col("query_id") != F.col(id_col))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col)
    return near.select("query_id", F.row_number().over(order).alias("rank"), id_col, "score").where(F.col("rank") <= k)


def calibration(base: DataFrame, queries: DataFrame, dims: int, k: int, as_stored) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """What fitted() takes: a sample of queries, their k nearest of all rows, and rows."""
    n_base, n_queries = base.count(), queries.count()

    def thinned(rows: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
        """`wanted` rows of least hashed ids; most others are left out before the sort."""
        key = F.xxhash64(F.col("id") + seed)
        return rows.where(F.pmod(key, F.lit(max(1, n // (8 * wanted)))) == 0).orderBy(key, "id").limit(wanted)

    few = sorted(thinned(queries, n_queries, SAMPLE_QUERIES, 0).collect(), key=lambda r: r["id"])
    ids, x = np.array([r["id"] for r in few], np.int64), np.frombuffer(b"".join(r["x"] for r in few)).reshape(-1, dims)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("id").to_numpy()
            score = x @ vectors_of(batch.column("x"), dims).T
            score[ids[:, None] == own] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), top.shape[1])), pa.array(own[top].reshape(-1)), pa.array(np.take_along_axis(score, top, 1).reshape(-1))], names=["q", "id", "score"])

    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    best = base.mapInArrow(nearest, "q long, id long, score double").where(F.col("score") > float("-inf"))
    best = best.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).select("q", "id")
    pairs = sorted((r["q"], r["id"], r["x"]) for r in best.join(base, "id").collect())  # SAMPLE_QUERIES * k rows at most
    rows = [r["x"] for r in thinned(base, n_base, SAMPLE_ROWS, 1).select("x").collect()]
    near, sample = (as_stored(np.frombuffer(b"".join(c)).reshape(-1, dims))[0] for c in ([p[2] for p in pairs], rows)) if rows else (np.zeros((0, dims + 1)),) * 2
    return asked(x), [(p[0], i) for i, p in enumerate(pairs)], near if pairs else np.zeros((0, dims + 1)), sample


def deal_batch(table: int, groups: np.ndarray, role: int, ids: np.ndarray, codes: pa.Array, x: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, table)), pa.array(groups.astype(np.int64)), pa.array(np.full(n, role, np.int32)), pa.array(ids), codes, x], names=["t", "g", "role", "id", "codes", "x"])


def one_cell(n: int) -> pa.Array:
    """A list of the one code 0 for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(np.zeros(n, np.int64)))
