"""An exact Jaccard join of five-word shingle sets by set-relation skipping.

All documents share one order of shingles: by how often what hashes to the same of
2^18 counters occurs in the corpus, rare ones first, then by hash. Of two sets of the
similarity asked for, the first n - ceil(percent n) + l shingles of each have l in
common, so only these are indexed, as (shingle, document, size, place), and a document
that meets fewer than l others' entries is done. l is a tenth of the size, which
passages that many documents share don't reach.

Skipping in the index: entries of one size and place behave alike. What a shingle at
place i of one set and j of another still allows them to have in common follows from
the sizes, so a block of entries is passed over as a whole where that isn't enough.

Skipping of answers: in each index list all sets are compared with that which meets
most others, and links give components. Where lists still hold several components, it
is counted how many of them a document shares with each other component, and only
components whose documents share enough are looked at, as blocks, and of these only
sets whose counts by last byte allow them enough in common. Lists of more components
than can be counted so are joined where they hold much the same sets. In a block, a set
takes over what its leader, an earlier set of its component that is highly similar, has
computed: |x and y| is at most |X and Y| of the leaders plus what x and y have more than
these, so that mostly two whole families are passed over after one comparison. Where
that bound doesn't decide, only the shingles in which members differ from their leaders
are looked up. Sets already connected aren't compared, so no link between components is
lost and no list of pairs is made.

Scale: two passes over the texts, for the counters (at most 2^18 numbers a task, summed
before the driver sees them) and for sizes, hashes and first shingles. Equal sets are
one class, so that copies count once. Index rows are about 0.3 of the shingles. Hot
shingles, leaders and classes are dealt over salts, large lists over pairs of chunks.

Cases: null, empty and blank texts have an empty set, stand alone and are linked with
nothing; shorter texts than five words are one shingle; texts of one set are one class
whatever their order; repeated rows are copies of each other; rows without an id are
never a smallest one; an id on several texts is linked by each of them; an empty table
gives no rows. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import cut, hot_keys, slices, small_side, spread_join, staged
from gridframe.llm.near_dups import linked_documents, rooted_classes, shingle_sets

COUNTER_BITS = 18
#: The share of a set's size by which its indexed part is longer than for one common
#: shingle, as a part of so many.
LONGER = 10
#: From this level on (64 times the mean) a counter is hot.
HOT = 6
#: Percent of similarity from which a set takes over a leader's answers.
HIGH = 90
#: Comparisons of a set and a component by their counts, in one bucket at most.
SIFTED = 2_000_000
#: Leaders of its component that a set is held against.
TRIED = 8


def occurrences(docs: DataFrame) -> np.ndarray:
    """How many shingles of all documents' sets fall to each counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for part in slices(batches, ["__text"], 1_000_000, "__text"):
            sets, _ = shingle_sets(part["__text"])
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["at", "n"])

    out = np.zeros(1 << COUNTER_BITS, np.int64)
    summed = docs.select("__text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most 2^18 rows
    out[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for counters of up to twice the mean, then one more for every doubling."""
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / max(1.0, counts.mean())))).astype(np.uint8)


def shared(n: int) -> int:
    """How many of their first shingles two similar sets, of that size and larger, share."""
    return 1 + n // LONGER


def sketches(docs: DataFrame, percent: int, level: np.ndarray) -> DataFrame:
    """doc, n, f1 and f2 (128 bits of the set), first (the shingles to be indexed, in the
    common order), cool (how many of these come before those of hot counters) and bins
    (how many of the set end in each byte, up to 255) of each row."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("cool", pa.int32()), ("bins", pa.binary()), ("first", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ["__id", "__text"], 1_000_000, "__text"):
            sets, _ = shingle_sets(part["__text"])
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            first, cool = [], []
            bins = [np.minimum(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for s in sets]
            for s in sets:
                n, own = len(s), level[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                order = np.argsort(own, kind="stable")[: n - -(-percent * n // 100) + shared(n) if n else 0]
                first.append(s[order].view(np.int64))
                cool.append(int((own[order] < HOT).sum()))
            offsets = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays([pa.array(part["__id"], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(cool, pa.int32()), pa.array(bins, pa.binary()), lists], schema=schema)

    return docs.mapInArrow(run, "doc long, n long, f1 long, f2 long, cool int, bins binary, first array<long>")


def least_common(a: int, b: int, percent: int) -> int:
    """What sets of these sizes have in common at least, if they are similar."""
    return -(-percent * (a + b) // (100 + percent))


def inside(few: np.ndarray, many: np.ndarray) -> int:
    """How many of few are in the sorted many."""
    if not len(few) or not len(many):
        return 0
    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
    return int((many[at] == few).sum())


class Family:
    """A leader and the sets of its component that are highly similar to it: what each has
    more and less than the leader. codes: how many shingles the block has."""

    def __init__(self, own: np.ndarray, root: int, codes: int):
        self.own, self.root = own, root
        has = np.zeros(codes, bool)
        has[own] = True
        self.bits = np.packbits(has, bitorder="little")
        self.members: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # set, size, more, less
        self.most_more, self.least = 0, len(own)

    def has(self, own: np.ndarray) -> np.ndarray:
        return (self.bits[own >> 3] >> (own & 7)) & 1 > 0

    def common(self, own: np.ndarray) -> int:
        return int(np.count_nonzero(self.has(own)))

    def takes(self, x: int, own: np.ndarray) -> bool:
        there = self.has(own)
        both = int(np.count_nonzero(there))
        if 100 * both < HIGH * (len(self.own) + len(own) - both):
            return False
        more = own[~there]
        self.members.append((x, len(own), more, np.setdiff1d(self.own, own, assume_unique=True)))
        self.most_more, self.least = max(self.most_more, len(more)), min(self.least, len(own))
        return True


def linked_members(f: Family, g: Family, both: int, percent: int, ordered: list[np.ndarray]) -> tuple[int, int] | None:
    """A pair of similar members of two families whose leaders have `both` in common."""
    n, m = (np.array([x[1] for x in own.members]) for own in (f, g))
    more_f, more_g = (np.array([len(x[2]) for x in own.members]) for own in (f, g))
    need = -(-percent * (n[:, None] + m[None, :]) // (100 + percent))
    open_ = (both + more_f[:, None] + more_g[None, :] >= need) & (100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :]))
    leader_and: dict[int, int] = {}  # a member of g -> what it has in common with f's leader
    for i, j in zip(*np.nonzero(open_)):
        x, _, more_x, less_x = f.members[i]
        y, _, more_y, less_y = g.members[j]
        if j not in leader_and:
            leader_and[j] = both - f.common(less_y) + f.common(more_y)
        theirs = leader_and[j]
        if theirs + len(more_x) < need[i, j]:
            continue
        if theirs - len(less_x) >= need[i, j] or theirs - inside(less_x, ordered[y]) + inside(more_x, ordered[y]) >= need[i, j]:
            return x, y
    return None


def skip_links(sets: list[np.ndarray], docs: list[int], roots: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect the block's components: sorted sets, their documents, and the
    components they belong to."""
    root = {r: r for r in roots}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    code = rank[code]  # rare shingles first
    starts = np.cumsum([0, *sizes.tolist()])
    ordered = [np.sort(code[a:b]) for a, b in zip(starts, starts[1:])]
    # Shingles of one component alone lead to no link.
    number = np.unique(roots, return_inverse=True)[1]
    least, most = np.full(len(count), len(sets)), np.full(len(count), -1)
    np.minimum.at(least, code, np.repeat(number, sizes))
    np.maximum.at(most, code, np.repeat(number, sizes))
    across = least < most
    index: dict[int, dict[tuple[int, int], set[int]]] = {}  # shingle -> (size, place) -> families
    families: list[Family] = []
    of_root: dict[int, list[int]] = {}
    met: dict[tuple[int, int], None] = {}
    for x in sorted(range(len(sets)), key=lambda i: (sizes[i], docs[i])):
        own, n = ordered[x], int(sizes[x])
        # A set that none of the last few leaders takes leads a family of its own.
        mine = next((f for f in of_root.get(roots[x], [])[: -TRIED - 1 : -1] if families[f].takes(x, own)), None)
        if mine is None:
            mine = len(families)
            families.append(Family(own, roots[x], len(count)))
            families[mine].takes(x, own)
            of_root.setdefault(roots[x], []).append(mine)
        first = own[: n - -(-percent * n // 100) + 1]
        places = np.flatnonzero(across[first])
        for i, shingle in zip(places.tolist(), first[places].tolist()):
            blocks = index.setdefault(shingle, {})
            for (m, j), block in blocks.items():
                if 100 * m >= percent * n and min(i, j) + 1 + min(n - i, m - j) - 1 >= least_common(n, m, percent):
                    for other in block:
                        if families[other].root != roots[x]:
                            met[min(mine, other), max(mine, other)] = None
            blocks.setdefault((n, i), set()).add(mine)
    links = []
    for a, b in met:
        f, g = families[a], families[b]
        if find(f.root) == find(g.root):
            continue
        both = f.common(g.own)
        if both + f.most_more + g.most_more < least_common(f.least, g.least, percent):
            continue
        pair = linked_members(f, g, both, percent, ordered)
        if pair:
            links.append((docs[pair[0]], docs[pair[1]]))
            root[find(f.root)] = find(g.root)
    return links


def live_entries(reps: DataFrame, percent: int) -> DataFrame:
    """bucket, doc, n and pos of the index: entries of shingles that others have as well,
    of documents with as many of these as similar ones share. Shingles of hot counters
    count as such without being looked at together."""
    rows = reps.select("doc", F.col("n").cast("int").alias("n"), "cool", F.posexplode("first").alias("pos", "bucket"))
    hot = F.col("pos") >= F.col("cool")
    rows = rows.select("bucket", "doc", "n", "pos", hot.alias("hot"), F.when(hot, F.col("doc")).alias("apart"))
    rows = rows.withColumn("m", F.count("*").over(Window.partitionBy("bucket", "apart"))).where("m > 1 or hot").drop("m", "hot", "apart")
    return rows.withColumn("met", F.count("*").over(Window.partitionBy("doc"))).where(F.col("met") >= least_shared(percent)).drop("met")


def least_shared(percent: int) -> Column:
    """shared() of the smallest size that is similar to a set of n."""
    return 1 + F.floor(F.floor((F.col("n") * percent + 99) / 100) / LONGER)


def shared_of(n: Column, m: Column, percent: int) -> Column:
    """How many entries similar sets of n and m shingles share. Of those in common, all
    but n less what is indexed can lie beyond one's indexed part, and likewise for m."""
    in_common = F.ceil(percent * (n + m) / F.lit(100 + percent))
    beyond = [F.ceil(k * percent / 100) - 1 - F.floor(k / LONGER) for k in (n, m)]
    return in_common - F.greatest(*beyond)


def shared_in_range(n: Column, low: Column, high: Column, percent: int) -> Column:
    """The least of shared_of(n, m) for m from low to high. Without its rounding, by which
    a single m may undercut both ends, it is concave in m, so least at an end."""
    unrounded = [percent * (n + m) / F.lit(100 + percent) - F.greatest(n, m) * (percent / 100 - 1 / LONGER) - (LONGER - 1) / LONGER for m in (low, high)]
    bound = F.ceil(F.least(*unrounded) - 1e-6)
    return F.when(low == high, shared_of(n, low, percent)).otherwise(F.greatest(bound, F.lit(1)))


def may_be_similar(rows: DataFrame, bins: DataFrame, percent: int) -> DataFrame:
    """rows(bucket, doc, root, n) whose document may be similar to one of another root in
    its bucket, by bins(doc, bins): two sets have no more in common than the sum of their
    lesser counts, and a set and a component no more than that with the component's
    greatest counts. Buckets beyond SIFTED comparisons are handed on whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            docs, roots, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            names, at = np.unique(roots, return_inverse=True)
            keep = np.ones(len(docs), bool)
            if len(docs) * len(names) <= SIFTED:
                counts = np.frombuffer(b"".join(b for h in held for b in h[3]), np.uint8).reshape(len(docs), 256).astype(np.int32)
                keep = (counts == 255).any(axis=1)
                most, least = np.zeros((len(names), 256), np.int32), np.full(len(names), np.iinfo(np.int64).max)
                np.maximum.at(most, at, counts)
                np.minimum.at(least, at, n)
                for r in range(len(names)):
                    need = least_common(n, np.maximum(least[r], -(-percent * n // 100)), percent)
                    keep |= (at != r) & ((np.minimum(counts, most[r]).sum(axis=1) >= need) | (most[r] == 255).any())
            if len(np.unique(at[keep])) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), bucket)), pa.array(docs[keep]), pa.array(roots[keep]), pa.array(n[keep])], names=["bucket", "doc", "root", "n"])

        for batch in batches:
            buckets, docs, roots, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "doc", "root", "n"))
            vectors = batch.column("bins").to_pylist()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if held and bucket != buckets[start]:
                    yield from done()
                    held = []
                bucket = int(buckets[start])
                held.append((docs[start:end], roots[start:end], n[start:end], vectors[start:end]))
        if held:
            yield from done()

    dealt = rows.join(bins, "doc").select("bucket", "doc", "root", F.col("n").cast("long").alias("n"), "bins")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket long, doc long, root long, n long")


def linked_by_shingles(docs: DataFrame, percent: int) -> DataFrame:
    """doc, n and root of each row of docs(__id, __text), where an id has one row."""
    level = levels(occurrences(docs))
    drawn = staged(sketches(docs, percent, level))
    classes = cut(drawn.where("n > 0").groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")))
    several = classes.where("copies > 1")
    copies = spread_join(drawn.select("f1", "f2", "doc"), several, ["f1", "f2"], hot_keys(several, "f1", "copies"), ["doc"]).where("doc <> rep").select("doc")
    copies = staged(copies)
    reps = drawn.where("n > 0 and doc is not null").join(small_side(copies, copies.count()), "doc", "left_anti")
    entries = staged(live_entries(reps, percent))
    wanted = cut(entries.select("doc").distinct())
    texts = cut(docs.join(small_side(wanted, wanted.count()), F.col("__id") == F.col("doc"), "left_semi"))
    bins = drawn.where("doc is not null").join(wanted, "doc", "left_semi").select("doc", "bins")
    how = {"need": lambda n, low, high: shared_in_range(n, low, high, percent), "join": skip_links, "sift": lambda rows: may_be_similar(rows, bins, percent)}
    return rooted_classes(texts, drawn.drop("first", "cool", "bins"), classes, entries, percent, **how)


def jaccard_join(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept of each row of docs."""
    return linked_documents(docs, lambda named: linked_by_shingles(named, percent), id_col, text)
