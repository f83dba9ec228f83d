"""Near-duplicates by circulant MinHash, with exact verification.

A document's words, ASCII-lower-cased, give its set of five-word shingles, each
a 64-bit value. Two permutations make the whole signature: the first spreads the
shingles over a ring of 2^32 places, the second ranks the places, and coordinate
k is the least rank after a turn of the ring by k places. Bands of ROWS
coordinates give the buckets in which candidates meet. There are as many bands as
keep the probability that a pair just similar enough shares none within MISS: 29
bands of 5 at a similarity of 0.8, 20 at 0.85.

Texts of equal word sequences are one class, so that a group of copies counts
once. In each bucket all members are compared with one pivot, the member that
meets most others over all its bands; links give components. A bucket that still
holds several components is compared throughout, in blocks of bounded size, by
exact prefix filtering: so every pair in a bucket is linked, known not to be, or
already connected, and no pair of a bucket is ever listed. Links are confirmed
on full sets, from whole texts.

Scale: the text is read twice, once for narrow sketches kept in the shared
folder and once for those documents that share a bucket. Buckets, pivots and
components are aggregated before they are shuffled; where rows meet their
bucket's, pivot's or class's row, those of a hot one are dealt over salts. A
pivot's members are dealt over salts by their bytes, a large bucket over pairs of
chunks.

Cases: null, empty and blank texts have an empty set, stand alone and are linked
with nothing; shorter texts than five words are one shingle; repeated rows are
copies of each other; a row without an id can't stand for its group, and is not
kept; an id that stands on different texts is one document of several sets, and a
link of one of them is a link of the id; an empty table gives no rows; further
columns aren't read. one_of_each() keys rows without an id by their text, so that
they too can stand for their group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import BROADCAST_ROWS, cut, hot_keys, slices, small_side, spread_join, staged
from gridframe.llm.components import components

WORDS = 5
ROWS, MISS = 5, 1e-5
SALT_BYTES = 1_000_000
CHUNK_BYTES = 2_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """The words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str | None]) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """Each text's sorted distinct shingles, and its words."""
    split = [words_of(t) for t in texts]
    words = [w for s in split for w in s]
    if not words:
        return [np.zeros(0, np.uint64) for _ in texts], split
    codes, found = pd.factorize(np.array(words, dtype=object))
    hashes = mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))[codes]
    rolled = np.zeros(len(hashes), np.uint64)
    factor = 1
    for k in range(WORDS):  # a polynomial in an odd constant keeps the order of words
        rolled[: len(hashes) - k] += hashes[k:] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % 2**64
    rolled = mix64(rolled)
    sets, at = [], 0
    for s in split:
        n = len(s)
        if n >= WORDS:
            sets.append(np.unique(rolled[at : at + n - WORDS + 1]))
        elif n:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(s), seed=n)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets, split


def ranked(places: np.ndarray) -> np.ndarray:
    """The second permutation, of the ring's 2^32 places."""
    x = places ^ (places >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def bands_for(percent: int) -> int:
    """The least number of bands that a pair of that similarity misses with a
    probability of at most MISS."""
    shared = (percent / 100) ** ROWS
    return 1 if shared >= 1 else math.ceil(math.log(MISS) / math.log1p(-shared))


def band_keys(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """So many keys for each set (none empty)."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    places = (mix64(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = mix64(key ^ np.minimum.reduceat(ranked(places + np.uint32(k)), starts).astype(np.uint64))
        keys[:, band] = key
    return keys


def sketches(docs: DataFrame, percent: int, id_col: str, text: str) -> DataFrame:
    """doc, n (shingles), f1 and f2 (128 bits of the word sequence) and keys (band keys)."""
    bands = bands_for(percent)
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ["__id", "__text"], 1_000_000, "__text"):
            sets, split = shingle_sets(part["__text"])
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[list[int]] = [[] for _ in sets]
            if some:
                for i, row in zip(some, band_keys([sets[i] for i in some], bands).view(np.int64).tolist()):
                    keys[i] = row
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(s)) for s in split), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(part["__id"], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    return named.mapInArrow(run, "doc long, n long, f1 long, f2 long, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def star_links(dealt: DataFrame, percent: int) -> DataFrame:
    """Links a, b of dealt(pivot, salt, role, doc, text): in each (pivot, salt) the
    pivot (role 0) comes first, then the members, so one set is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, None
        for part in slices(batches, ["pivot", "role", "doc", "text"]):
            sets, _ = shingle_sets(part["text"])
            found = []
            for p, role, doc, own in zip(part["pivot"], part["role"], part["doc"], sets):
                if role == 0:
                    pivot, held = p, own
                elif p == pivot and similar(held, own, percent):
                    found.append((doc, p))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    ordered = dealt.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return ordered.select("pivot", "role", "doc", "text").mapInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], docs: list[int], roots: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect the block's components. Two sets that are similar share a
    shingle among the first n - ceil(percent n) + 1 of each, rarest first. Sets of
    components that are connected already aren't compared."""
    root = {r: r for r in roots}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((shingle, count[shingle], owner))
    owner, shingle = owner[order], shingle[order]
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = (rank < (sizes - -(-percent * sizes // 100) + 1)[owner]) & (count[shingle] > 1)
    owner, shingle = owner[prefix], shingle[prefix]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    links, tried = [], set()
    for group in np.split(owner, np.flatnonzero(shingle[1:] != shingle[:-1]) + 1):
        seen: dict[int, list[int]] = {}  # a component's members so far
        for i in group.tolist():
            own = find(roots[i])
            for other in [r for r in seen if r != own]:
                for j in seen[other]:
                    pair = i * len(sets) + j
                    if pair not in tried:
                        tried.add(pair)
                        if similar(sets[i], sets[j], percent):
                            links.append((docs[i], docs[j]))
                            root[own] = other
                            seen[other] += seen.pop(own, [])
                            own = other
                            break
            seen.setdefault(own, []).append(i)
    return links


def rest_links(dealt: DataFrame, percent: int, join: Callable = block_links) -> DataFrame:
    """Links a, b of dealt(block, doc, root, text), whose blocks lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets, docs, roots = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            found = join(sets, docs, roots, percent) if len(set(roots)) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for part in slices(batches, ["block", "doc", "root", "text"]):
            made, _ = shingle_sets(part["text"])
            for b, doc, r, own in zip(part["block"], part["doc"], part["root"], made):
                if b != block:
                    yield from done()
                    block, sets, docs, roots = b, [], [], []
                sets.append(own)
                docs.append(doc)
                roots.append(r)
        yield from done()

    ordered = dealt.repartition("block").sortWithinPartitions("block", "doc")
    return ordered.select("block", "doc", "root", "text").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """wanted(doc, ...) with each document's text. Rows of one id have one text."""
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    return wanted.join(named, "doc")


#: Buckets of at most so many components tell which components meet in them.
MOST_ROOTS = 64
#: Rounds in which buckets of much the same documents are joined.
MERGES = 3


def merged(rows: DataFrame) -> DataFrame:
    """rows(bucket, doc, root, n) with buckets of much the same documents joined, so that
    documents which meet in many buckets are compared once. In each round, buckets whose
    documents have the same least hash become one where that has no more pairs than they
    have apart. All documents of a bucket stay together."""
    if rows.isEmpty():
        return rows
    for turn in range(MERGES):
        sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min(F.xxhash64("doc", F.lit(turn))).alias("least")))
        hot = hot_keys(sizes, "bucket", "m")
        named = staged(spread_join(rows, sizes.select("bucket", "least"), ["bucket"], hot, ["doc"]))
        apart = sizes.groupBy("least").agg(F.count("*").alias("buckets"), F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs")).where("buckets > 1")
        docs = named.groupBy("least", "doc").agg(F.lit(1).alias("one")).groupBy("least").agg(F.count("*").cast("double").alias("d"))
        joined = cut(apart.join(docs, "least").where("d * d <= pairs").select("least", F.lit(True).alias("joined")))
        if joined.isEmpty():
            continue
        large = hot_keys(sizes.groupBy("least").agg(F.sum("m").alias("m")), "least", "m")
        rows = spread_join(named, joined, ["least"], large, ["doc"], "left")
        rows = staged(rows.select(F.when(F.col("joined"), F.xxhash64("least", F.lit(turn))).otherwise(F.col("bucket")).alias("bucket"), "doc", "root", "n").distinct())
    return rows


def meeting(rooted: DataFrame, percent: int, need: Callable[[Column, Column, Column], Column], hot: list) -> DataFrame:
    """Buckets, doc, root and n of the documents that may still be similar to one of
    another component, of rooted(bucket, doc, root, n), where a document of n shingles
    meets similar ones of low to high shingles in need(n, low, high) buckets at least.

    Buckets of few components tell how often a document meets each other component, and
    of what sizes; in one of many it may have met any. Where that is enough from both
    sides, the two components' documents are a bucket of their own. Documents for which
    buckets of many components are enough stay in these, of which those of much the same
    documents are joined."""
    n, at_least, at_most = F.col("n"), F.ceil(F.col("n") * percent / 100), F.floor(F.col("n") * 100 / F.lit(percent))
    pairs = rooted.groupBy("bucket", "root").agg(F.min("n").alias("low_n"), F.max("n").alias("high_n"))
    kinds = pairs.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    kinds = staged(kinds.withColumn("big", F.col("k") > MOST_ROOTS).drop("k"))
    rows = staged(spread_join(rooted, kinds, ["bucket"], hot, ["doc"]))
    big = rows.where("big").groupBy("doc").agg(F.count("*").alias("bigs"))
    others = pairs.join(kinds.where("not big").select("bucket"), "bucket").withColumnRenamed("root", "other")
    met = spread_join(rows.where("not big"), others, ["bucket"], hot, ["doc"]).where(F.col("root") != F.col("other"))
    met = met.where((F.col("high_n") >= at_least) & (F.col("low_n") <= at_most))
    met = met.groupBy("doc", "other").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.count("*").alias("times"), F.min("low_n").alias("low_n"), F.max("high_n").alias("high_n"))
    low_n, high_n = F.greatest("low_n", at_least), F.least("high_n", at_most)
    met = met.join(big, "doc", "left").where(F.col("times") + F.coalesce("bigs", F.lit(0)) >= need(n, low_n, high_n))
    met = staged(met.select(F.least("root", "other").alias("low"), F.greatest("root", "other").alias("high"), "doc", "root", "n"))
    both = met.groupBy("low", "high").agg((F.min("root") < F.max("root")).alias("both"), F.count("*").alias("members")).where("both")
    both = staged(both)
    apart = spread_join(met, both.select("low", "high"), ["low", "high"], hot_keys(both, "low", "members"), ["doc"]).select(F.xxhash64("low", "high").alias("bucket"), "doc", "root", "n")
    still = rows.where("big").join(big, "doc").where(F.col("bigs") >= need(n, at_least, at_most)).select("bucket", "doc", "root", "n")
    return apart.unionByName(merged(staged(still)))


def class_links(docs: DataFrame, banded: DataFrame, percent: int, id_col: str, text: str, need: Callable[[Column, Column, Column], Column] | None = None, join: Callable = block_links, sift: Callable = lambda rows: rows) -> DataFrame:
    """node and root of every document that is connected with a smaller one.

    banded(bucket, doc, n) are the buckets of documents, one for each class of equal
    sets. With `need`, bucket is a shingle and pos its place in the document's order, which
    all documents share, and one of n shingles meets similar ones of low to high shingles
    in need(n, low, high) of them at least. join: finds the links of a block, as block_links does. sift: leaves out rows
    of (bucket, doc, root, n) whose documents can't be similar to others of their bucket."""
    sizes = cut(banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"))
    hot = hot_keys(sizes, "bucket", "m")
    members = (cut if need is None else staged)(spread_join(banded, sizes, ["bucket"], hot, ["doc"]))
    met = members.groupBy("doc").agg(F.sum("m").alias("met"))
    own = ["doc", "n", "pos"] if "pos" in banded.columns else ["doc", "n"]
    pivots = members.join(met, "doc").groupBy("bucket").agg(F.max_by(F.struct(*own), F.struct("met", "doc")).alias("p"))
    pivots = pivots.select("bucket", *[F.col(f"p.{c}").alias("pivot" if c == "doc" else f"pivot_{c}") for c in own])
    met_pivot = spread_join(members, pivots, ["bucket"], hot, ["doc"]).where(F.col("doc") != F.col("pivot"))
    met_pivot = met_pivot.where(100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n"))
    if "pos" in banded.columns:
        most = F.least("pos", "pivot_pos") + 1 + F.least(F.col("n") - F.col("pos"), F.col("pivot_n") - F.col("pivot_pos")) - 1
        met_pivot = met_pivot.where((100 + percent) * most >= percent * (F.col("n") + F.col("pivot_n")))
    edges = cut(met_pivot.groupBy("doc", "pivot").agg((F.first("n") * F.lit(8).cast("long")).alias("bytes")))
    salts = cut(edges.groupBy("pivot").agg(F.ceil(F.sum("bytes") / SALT_BYTES).cast("int").alias("salts"), F.count("*").alias("members")))
    member = spread_join(edges, salts.drop("members"), ["pivot"], hot_keys(salts, "pivot", "members"), ["doc"]).select("doc", "pivot", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
    pivot = salts.select(F.col("pivot").alias("doc"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    links = cut(star_links(texts_of(docs, member.unionByName(pivot), id_col, text), percent))
    found = components(links)

    # Buckets that still hold several components; in one of two rows the pivot was compared.
    rooted = members.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    rooted = (cut if need is None else staged)(rooted.where("m > 2").select("bucket", "doc", "root", "n"))
    several = F.min("root") < F.max("root")
    if need is not None:
        rooted = staged(sift(staged(meeting(rooted, percent, need, hot))))
        hot = hot_keys(rooted.groupBy("bucket").agg(F.count("*").alias("m")), "bucket", "m")
    open_ = rooted.groupBy("bucket").agg(
        several.alias("open"), F.count("*").alias("m"), (F.sum("n") * 8).alias("held"),
        F.bit_xor(F.xxhash64("doc")).alias("x"), F.sum(F.col("doc").cast("decimal(38,0)")).alias("s"),
    ).where("open")
    open_ = open_.groupBy("m", "x", "s").agg(F.min("bucket").alias("bucket"), F.first("held").alias("held"))  # the same members meet in many bands
    chunks = open_.select("bucket", F.greatest(F.ceil(F.col("held") / CHUNK_BYTES), F.lit(1)).cast("int").alias("g"))
    chunked = spread_join(rooted, chunks, ["bucket"], hot, ["doc"]).withColumn("c", F.pmod(F.xxhash64("doc"), F.col("g")).cast("int"))
    chunked = chunked.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    block = F.xxhash64("bucket", F.least("c", "d"), F.greatest("c", "d"))
    dealt = texts_of(docs, chunked.select("doc", "root", block.alias("block")), id_col, text)
    more = cut(rest_links(dealt, percent, join))
    if more.isEmpty():
        return found
    return components(links.unionByName(more))


def rooted_classes(docs: DataFrame, drawn: DataFrame, classes: DataFrame, banded: DataFrame, percent: int, **how) -> DataFrame:
    """doc, n and root of each row of drawn(doc, n, f1, f2): the smallest document that
    its class is connected with. classes(f1, f2, rep, copies): of equal sets. docs has
    the texts of all documents in banded, once each."""
    roots = class_links(docs, banded, percent, "__id", "__text", **how)
    known = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = known.where("copies > 1 or root <> rep").select("f1", "f2", "root")
    out = spread_join(drawn.where("n > 0"), known, ["f1", "f2"], hot_keys(classes, "f1", "copies"), ["doc"], "left").unionByName(drawn.where("n = 0"), allowMissingColumns=True)
    return out.select("doc", "n", F.coalesce("root", "doc").alias("root"))


def linked_by_minhash(docs: DataFrame, percent: int) -> DataFrame:
    """doc, n and root of each row of docs(__id, __text), where an id has one row."""
    drawn = cut(sketches(docs, percent, "__id", "__text"))
    classes = cut(drawn.where("n > 0").groupBy("f1", "f2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")))
    reps = drawn.join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi")
    banded = cut(reps.select("doc", F.col("n").cast("int").alias("n"), F.explode("keys").alias("bucket")))
    texts = docs.join(classes.select(F.col("rep").alias("__id")), "__id", "left_semi")
    return rooted_classes(texts, drawn.drop("keys"), classes, banded, percent)


def linked_documents(docs: DataFrame, link: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept of each row of docs, by a function that
    links documents(__id, __text) of one row an id.

    Where an id stands on several rows, each of its texts is linked under a key of its
    own (from 2^62 on), and then what its texts are linked with is one component."""
    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    many = cut(named.where("__id is not null").groupBy("__id").agg(F.count("*").alias("__rows")).where("__rows > 1"))
    ids = many.count()
    if ids == 0:
        out = link(named)
    else:
        side = many.select("__id", F.lit(True).alias("__many"))
        joined = named.join(small_side(side, ids), "__id", "left") if ids <= BROADCAST_ROWS else spread_join(named, side, ["__id"], hot_keys(many, "__id", "__rows"), ["__text"], "left")
        key = F.when(F.col("__many"), F.shiftrightunsigned(F.xxhash64("__id", "__text"), 2) + F.lit(2**62)).otherwise(F.col("__id"))
        keyed = cut(joined.select(key.alias("__key"), "__id", "__text", "__many"))
        real = keyed.where("__many").groupBy(F.col("__key").alias("doc")).agg(F.first("__id").alias("__real"), F.count("*").alias("__rows"))
        once = keyed.where("__many").groupBy("__key").agg(F.first("__text").alias("__text")).unionByName(keyed.where("__many is null").select("__key", "__text"))
        rows = cut(link(once.withColumnRenamed("__key", "__id")).join(real, "doc", "left"))
        several = cut(rows.where("__real is not null").select("__real", "root").distinct())
        pairs = several.join(several.groupBy("__real").agg(F.min("root").alias("least")), "__real")
        merged = components(pairs.select(F.col("root").alias("a"), F.col("least").alias("b")))
        sizes = cut(rows.groupBy("root").agg(F.count("*").alias("members"), F.min(F.coalesce("__real", "doc")).alias("least")))
        groups = sizes.join(merged.withColumnRenamed("root", "whole").withColumnRenamed("node", "root"), "root", "left").withColumn("whole", F.coalesce("whole", "root"))
        least = groups.groupBy("whole").agg(F.min("least").alias("id"))
        groups = groups.join(least, "whole").select("root", "id")
        out = spread_join(rows, groups, ["root"], hot_keys(sizes, "root", "members"), ["doc"], "left")
        out = out.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("__rows", F.lit(1).cast("long"))))).select(F.coalesce("__real", "doc").alias("doc"), "n", F.coalesce("id", "root").alias("root"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("doc") == F.col("root"), F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept of each row of docs."""
    return linked_documents(docs, lambda named: linked_by_minhash(named, percent), id_col, text)


def one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their group, as they are: one of each."""
    by_text = F.shiftrightunsigned(F.xxhash64(F.col(text)), 2) + F.lit(2**62)  # beyond any likely id
    key = F.coalesce(F.col(id_col).cast("long"), by_text)
    keyed = docs.select(key.alias("__id"), F.col(text).alias("__text"))
    kept = near_duplicates(keyed, percent, "__id", "__text").where("kept").groupBy(F.col("__id").alias("__kept")).agg(F.count("*").alias("__rows"))
    kept = cut(kept)
    rows = docs.join(kept.select("__kept").hint("shuffle_hash"), key == F.col("__kept"), "left_semi")
    return rows if kept.where("__rows > 1").isEmpty() else rows.dropDuplicates([id_col, text])
