"""Hard negatives by k-means inverted lists, visited by Cauchy-Schwarz bounds.

Every row lies in the list of its nearest centroid, and each list keeps its radius,
the largest distance of a member from the centroid c. A query a scores a member at
most a.c + |a| r and at least a.c - |a| r. A query first visits the lists of highest
bound that hold some FIRST_ROWS rows; then, with the kth score found there, all others
that aren't ruled out. Within a task the lists come in order of their bounds: those
whose scores all lie outside a query's windows are skipped, and a query is done with
lists whose bound is strictly below the kth score of every window.

Components are whole numbers, so that scores are exact; centroids are rounded to
whole numbers as well, and bounds are widened by more than their own rounding.

Anchors of one vector and label ask once. They ask for one positive more than they
need, as each leaves itself out; the positives' scores are the windows in which
negatives of other labels are looked for.

Scale: centroids are fitted on SAMPLE_ROWS rows, those whose hashed ids are least;
every row is indexed. Of rows of one vector and label only the few smallest ids can
be found, so a common vector doesn't grow a list. Lists are dealt into groups of
about GROUP_ROWS rows, a larger list into several; a query goes once to each group
that holds lists it visits. A group of many queries is dealt over salts. Only the
best k of each task are shuffled. The driver holds the centroids, radii and counts of
at most LISTS lists.

Cases: rows without an id or a label, without a vector, with null or non-finite
components, of another length than most, or with components so large that scores may
not fit 64 bits (beyond 9 * 10^7 in 64 dimensions) take no part. Repeated rows are rows of
their own: each but the anchor's own one may be its positive, and each is an anchor.
Zero vectors score 0. An anchor without positives, or a positive without negatives in
its window, gives no rows, as does an empty table. Further columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import cut, hot_keys, small_side, spread_join

LISTS, LIST_ROWS = 1024, 128
SAMPLE_ROWS, ROUNDS = 16_384, 8
FIRST_ROWS = 2_048
GROUP_ROWS = 16_384
ASKS_A_TASK = 4_096
CELLS = 2_000_000
NONE = -(2**62)


def whole_vectors(rows: DataFrame, id_col: str, label: Column, vector: str, scale: int) -> DataFrame:
    """id, label and vector (whole numbers) of the rows that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    made = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & (F.size(vector) > 0) & finite)
    made = made.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    common = made.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common["n"] if common else 1
    most = math.isqrt(2**59 // dim)
    fits = F.forall("vector", lambda x: (x < most) & (x > -most))
    return made.where((F.size("vector") == dim) & fits).withColumn("vector", F.col("vector").cast("array<int>"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, of lists of one length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, as 64-bit integers."""
    longest = [math.sqrt(float((x.astype(np.float64) ** 2).sum(axis=1).max())) if len(x) else 0.0 for x in (a, b)]
    if longest[0] * longest[1] < 2**52:  # no partial sum is longer
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def centroids(points: np.ndarray, k: int) -> np.ndarray:
    """k whole centroids of the points, by Lloyd's rounds from the first k of them."""
    x = points.astype(np.float64)
    if not k:
        return np.zeros((0, x.shape[1]), np.int64)
    c = x[:k].copy()
    for _ in range(ROUNDS):
        own = np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(np.rint(c).astype(np.int64), axis=0)


class Lists:
    """The index: its rows, dealt into groups, and what the driver knows of each list."""

    def __init__(self, rows: DataFrame):
        total = rows.count()
        thin = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < max(1, math.ceil(2 * SAMPLE_ROWS / max(total, 1) * 1_000_003)))
        sample = thin.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE_ROWS).select("vector").toArrow()
        points = matrix(sample.column("vector")) if sample.num_rows else np.zeros((0, 1), np.int64)
        self.centres = c = centroids(points, min(LISTS, len(points), -(-total // LIST_ROWS)))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (c.astype(np.float64) ** 2).sum(axis=1) / 2
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    x = matrix(part.column("vector"))
                    own = np.argmax(x.astype(np.float64) @ c.T.astype(np.float64) - half, axis=1)
                    away = ((x - c[own]).astype(np.float64) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(away), part.column("id"), part.column("label"), part.column("vector")], names=["list", "away", "id", "label", "vector"])

        assigned = cut(rows.select("id", "label", "vector").mapInArrow(assign, "list int, away double, id long, label long, vector array<int>"))
        found = {r["list"]: (r["n"], r["away"]) for r in assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}  # at most LISTS rows
        self.sizes = np.array([found.get(i, (0, 0))[0] for i in range(len(c))], np.int64)
        self.radii = np.sqrt(np.array([found.get(i, (0, 0))[1] for i in range(len(c))], np.float64))
        # The first group of each list and how many it is dealt into.
        self.first, self.parts, group, held = np.zeros(len(c), np.int64), np.ones(len(c), np.int64), 0, 0
        for i, n in enumerate(self.sizes.tolist()):
            if held and held + n > GROUP_ROWS:
                group, held = group + 1, 0
            self.first[i], self.parts[i] = group, max(1, -(-n // GROUP_ROWS))
            held += n
            if self.parts[i] > 1:
                group, held = group + int(self.parts[i]), 0
        lookup = [F.array(*[F.lit(int(x)) for x in a]) for a in (self.first, self.parts)] if len(c) else [F.array(F.lit(0))] * 2
        at = F.col("list") + 1
        self.rows = assigned.drop("away").withColumn("group", (F.element_at(lookup[0], at) + F.pmod(F.xxhash64("id"), F.element_at(lookup[1], at))).cast("long"))


ASK = "key string, label long, vector array<int>, lows array<long>, highs array<long>, kths array<long>"


def asked(index: Lists, queries: DataFrame, again: bool) -> DataFrame:
    """The queries (ASK) for each group of lists they visit, with these and their
    bounds: the first few lists, or again all others that aren't ruled out."""
    c, radii, sizes, first, parts = index.centres, index.radii, index.sizes, index.first, index.parts
    schema = pa.schema([("group", pa.int64()), ("key", pa.string()), ("label", pa.int64()), ("vector", pa.list_(pa.int32())), ("lows", pa.list_(pa.int64())), ("highs", pa.list_(pa.int64())), ("kths", pa.list_(pa.int64())), ("lists", pa.list_(pa.int32())), ("bounds", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                a = matrix(part.column("vector")).astype(np.float64)
                middle = a @ c.T.astype(np.float64)
                reach = np.linalg.norm(a, axis=1)[:, None] * radii[None, :] * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1
                out = []
                for row, up, down in zip(part.to_pylist(), middle + reach, middle - reach):
                    order = np.argsort(-up, kind="stable")
                    meets = np.zeros(len(c), bool)  # lists that may hold scores of a window
                    needed = np.zeros(len(c), bool)  # and such as its kth doesn't rule out
                    for low, high, kth in zip(row["lows"], row["highs"], row["kths"]):
                        inside = (up >= low) & (down <= high) & (low <= high)
                        meets |= inside
                        needed |= inside & (up >= kth)
                    order = order[meets[order] & (sizes[order] > 0)]
                    before = np.cumsum(sizes[order]) - sizes[order]
                    order = order[(before >= FIRST_ROWS) & needed[order]] if again else order[before < FIRST_ROWS]
                    by_group: dict[int, list[int]] = {}
                    for i in order.tolist():
                        for g in range(int(first[i]), int(first[i] + parts[i])):
                            by_group.setdefault(g, []).append(i)
                    out += [(g, row["key"], row["label"], row["vector"], row["lows"], row["highs"], row["kths"], own, up[own].tolist()) for g, own in by_group.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return queries.mapInArrow(run, "group long, " + ASK + ", lists array<int>, bounds array<double>")


class Held:
    """One group's lists in a task, and what queries find there."""

    def __init__(self, lists: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, lists))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        names, starts = np.unique(lists[order], return_index=True)
        self.spans = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)])))

    def find(self, asks: list[dict], k: int, same: bool) -> Iterator[tuple]:
        """(key, high, score, id, own) of the k best of each window of each ask; own: it
        equals the ask's vector."""
        width = max(len(r["lows"]) for r in asks)
        low, high, kth = (np.full((len(asks), width), fill, np.int64) for fill in (1, 0, 0))
        for q, r in enumerate(asks):
            n = len(r["lows"])
            low[q, :n], high[q, :n], kth[q, :n] = r["lows"], r["highs"], r["kths"]
        vectors = np.array([r["vector"] for r in asks], np.int64)
        labels = np.array([r["label"] for r in asks], np.int64)
        best = np.full((len(asks), width, k), NONE, np.int64)
        who = np.zeros((len(asks), width, k), np.int64)
        wanted: dict[int, tuple[list[int], list[float]]] = {}
        for q, r in enumerate(asks):
            for i, bound in zip(r["lists"], r["bounds"]):
                wanted.setdefault(i, ([], []))[0].append(q)
                wanted[i][1].append(bound)
        for i in sorted(wanted, key=lambda i: -max(wanted[i][1])):
            if i not in self.spans:  # another part of the list holds all of it
                continue
            start, end = self.spans[i]
            q, bound = np.array(wanted[i][0]), np.array(wanted[i][1])
            floor = np.maximum(low, np.maximum(kth, best[:, :, -1]))  # what still counts
            go = ((bound[:, None] >= floor[q]) & (low[q] <= high[q])).any(axis=1)
            q = q[go]
            step = max(1, CELLS // (end - start))
            for at in range(0, len(q), step):
                self.visit(q[at : at + step], start, end, vectors, labels, low, high, floor, best, who, same)
        square = (vectors * vectors).sum(axis=1)
        for q, w, r in zip(*np.nonzero(best > NONE)):
            own = same and best[q, w, r] == square[q] and bool((self.vectors[self.ids == who[q, w, r]] == vectors[q]).all(axis=1).any())
            yield asks[q]["key"], int(high[q, w]), int(best[q, w, r]), int(who[q, w, r]), own

    def visit(self, q, start, end, vectors, labels, low, high, floor, best, who, same) -> None:
        """Merge what the queries q find in the rows start to end into best and who."""
        k = best.shape[2]
        scores = products(vectors[q], self.vectors[start:end])
        fits = (labels[q][:, None] == self.labels[None, start:end]) == same
        fits &= (scores >= floor[q].min(axis=1)[:, None]) & (scores <= high[q].max(axis=1)[:, None])
        at, col = np.nonzero(fits)
        if not len(at):
            return
        found, ids = scores[at, col], self.ids[start + col]
        for w in range(best.shape[1]):
            keep = (found >= floor[q[at], w]) & (found <= high[q[at], w])
            if not keep.any():
                continue
            a, s, i = at[keep], found[keep], ids[keep]
            order = np.lexsort((i, -s, a))
            a, s, i = a[order], s[order], i[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            a, s, i, rank = a[rank < k], s[rank < k], i[rank < k], rank[rank < k]
            new = np.full((len(q), k), NONE, np.int64)
            new_ids = np.zeros((len(q), k), np.int64)
            new[a, rank], new_ids[a, rank] = s, i
            both, both_ids = np.concatenate([best[q, w], new], axis=1), np.concatenate([who[q, w], new_ids], axis=1)
            order = np.lexsort((both_ids, -both), axis=1)[:, :k]
            best[q, w], who[q, w] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)


def visited(index: Lists, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """key, window (its highest score), score, id and own of the k best of each window
    in each task that asks come to."""
    counts = cut(asks.groupBy("group").agg(F.count("*").alias("n")))
    salts = counts.select("group", F.ceil(F.col("n") / ASKS_A_TASK).cast("int").alias("salts"))
    n = counts.count()
    hot = hot_keys(counts, "group", "n")
    dealt = asks.join(small_side(salts, n), "group") if n <= 50_000 else spread_join(asks, salts, ["group"], hot, ["key"])
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    rows = index.rows.join(small_side(salts, n), "group").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    names = ["group", "salt", "side", "list", "id", "key", "label", "vector", "lows", "highs", "kths", "lists", "bounds"]
    both = rows.withColumn("side", F.lit(0)).unionByName(dealt.withColumn("side", F.lit(1)), allowMissingColumns=True).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("group", "salt", "side")])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part, (group, salt, side) = batch.slice(start, end - start), place[:, start].tolist()
                if side == 0:
                    if at != (group, salt):
                        at, parts, held = (group, salt), [], None
                    parts.append((*(part.column(c).to_numpy().astype(np.int64) for c in ("list", "id", "label")), matrix(part.column("vector"))))
                    continue
                if at != (group, salt):
                    continue
                if held is None:
                    held, parts = Held(*(np.concatenate(x) for x in zip(*parts))), []
                for from_ in range(0, part.num_rows, 512):
                    found = list(held.find(part.slice(from_, 512).select(["key", "label", "vector", "lows", "highs", "kths", "lists", "bounds"]).to_pylist(), k, same))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()])], names=["key", "window", "score", "id", "own"])

    ordered = both.repartition("group", "salt").sortWithinPartitions("group", "salt", "side")
    return ordered.mapInArrow(run, "key string, window long, score long, id long, own boolean")


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Lists, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """key, window, score, id, own and rank of the k best rows of each window of the
    queries (key, label, vector, lows, highs), of the query's label or of others."""
    blank = queries.withColumn("kths", F.transform("lows", lambda x: F.lit(NONE).cast("long")))
    first = cut(best_of(visited(index, asked(index, blank, False), k, same), k))
    kth = first.where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    known = queries.join(kth, "key", "left")
    known = known.withColumn("kths", F.transform("highs", lambda h: F.coalesce(F.col("kth")[h], F.lit(NONE).cast("long")))).drop("kth")
    more = visited(index, asked(index, known, True), k, same)
    return cut(best_of(first.drop("rank").unionByName(more), k))


def hard_negatives(
    rows: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, floor: tuple[int, int] = (4, 5)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    label: a row's label; anchors: whether it is an anchor, of its column id. A negative
    scores at least floor[0]/floor[1] times what the positive scores, and at most that."""
    valid = whole_vectors(rows, id_col, label, vector, scale)
    few = Window.partitionBy("vector", "label").orderBy("id")
    listed = cut(valid.withColumn("__n", F.row_number().over(few)).where(F.col("__n") <= max(positives + 1, negatives)).drop("__n"))
    index = Lists(listed)
    asking = valid.where(anchors).groupBy("id", "vector", "label").agg(F.count("*").alias("copies"))
    asking = cut(asking.withColumn("hash", F.xxhash64("vector", "label")))
    groups = cut(asking.groupBy("vector", "label", "hash").agg(F.min("id").alias("least"), F.count("*").alias("members")))
    groups = groups.withColumn("key", F.concat_ws(":", "least", "hash"))
    everything = {"lows": F.array(F.lit(NONE + 1).cast("long")), "highs": F.array(F.lit(2**62).cast("long"))}
    near = search(index, groups.select("key", "label", "vector").withColumns(everything), positives + 1, True)
    near = near.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "own")
    hot = hot_keys(groups, "key", "members")
    members = spread_join(asking, groups.select("hash", "vector", "label", "key"), ["hash", "vector", "label"], hot_keys(groups, "hash", "members"), ["id"])
    pairs = spread_join(members.select("key", F.col("id").alias("anchor_id"), "copies"), near, ["key"], hot, ["anchor_id"])
    # Of the rows equal to an anchor one is the anchor itself.
    itself = F.col("own") & (F.col("positive_id") == F.col("anchor_id"))
    order = [F.desc("positive_score"), "positive_id", F.desc("own")]
    pairs = pairs.withColumn("__itself", itself.cast("int")).withColumn("__turn", F.row_number().over(Window.partitionBy("key", "anchor_id", "__itself").orderBy(*order)))
    pairs = pairs.where((F.col("__itself") == 0) | (F.col("__turn") > 1))
    pairs = pairs.withColumn("__rank", F.row_number().over(Window.partitionBy("key", "anchor_id").orderBy(*order))).where(F.col("__rank") <= positives)
    pairs = cut(pairs.select("key", "anchor_id", "copies", "positive_id", "positive_score"))
    windows = pairs.groupBy("key").agg(F.array_sort(F.collect_set("positive_score")).alias("highs")).withColumn("lows", F.expr(f"transform(highs, s -> (s * {floor[0]} + pmod(-s * {floor[0]}, {floor[1]})) div {floor[1]})"))
    far = search(index, groups.select("key", "label", "vector").join(windows, "key"), negatives, False)
    far = far.select("key", F.col("window").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = spread_join(pairs, far, ["key", "positive_score"], hot, ["anchor_id"])
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
