"""The prefix trie of conversations, families first.

Conversations of one base id are a family: each is rebuilt as the first turns of
the base and then its own turns after as many. A family's turns come to one task in
order of their place, so that its small trie grows level by level: equal sequences
of turns meet in one node, and a level is handed on as soon as no conversation can
add to it. Only these combined nodes, keyed by a 128-bit hash of their sequence, are
shuffled once more and merged with those of other families.

What is summed over subtrees needs no walk of the tree. A node is owned by its
smallest member, and what a conversation owns is the end of its path. So a node's
subtree is the rest of its owner's path and all that the node's other members own:
a running sum along each path, and one sum over members a node.

Scale: texts become a 128-bit digest and a word count before anything is shuffled. A
family's task holds five levels of its members' nodes, whatever their turns. Common
first turns are one node a family; where nodes meet their parents, the children of a
hot one are dealt over salts. The ids that end in a node are joined into strings for
every SPAN ids, and only those strings are hashed in one sequence.

Cases: a null role or text is empty, a null turn comes first; turns of equal place
are ordered by the MD5 of role and text, and repeated rows are turns of their own;
rows without an id take no part. A base that the table doesn't hold gives no turns;
conversations without any turn left are members of the root alone. An empty table
gives no rows. Further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import cut, hot_keys, spread_join, text_or_empty
from gridframe.llm.mixing import word_count

SPAN_BITS = 16
ROOT = bytes(16)
KEY = ["k1", "k2"]


def placed_turns(turns: DataFrame, id_col: str, base: Column, shared: Column, most_shared: int, turn: str, role: str, text: str) -> DataFrame:
    """base, side, place, conv, shared, last, digest and words of every turn, each
    family together. Side 0: the base's first turns once more, ahead of the others."""
    role_, text_ = text_or_empty(role), text_or_empty(text)
    digest = F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_)))
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), base.cast("long").alias("base"), shared.cast("int").alias("shared"),
        F.col(turn).alias("turn"), digest.alias("digest"), word_count(text).alias("words"),
    )
    order = Window.partitionBy("base", "conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = rows.repartition("base").withColumns({"place": F.row_number().over(order).cast("long"), "last": F.lead(F.lit(False), 1, True).over(order)})
    ahead = (F.col("conv") == F.col("base")) & (F.col("place") <= most_shared)
    rows = rows.withColumn("side", F.explode(F.when(ahead, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    return rows.sortWithinPartitions("base", "side", "place", "conv").select("base", "side", "place", "conv", "shared", "last", "digest", "words")


def family_nodes(placed: DataFrame, most_shared: int) -> DataFrame:
    """k1 and k2 (the node), p1 and p2 (its parent), depth, words (of its last turn),
    members and ends (members without further turns), a row a node and family."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("words", pa.int64()), ("members", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def halves(key: bytes | None) -> tuple:
        return (None, None) if key is None else (int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, started = None, False
        levels: dict[int, dict[bytes, tuple]] = {}  # depth -> node -> (parent, words, members, ends)
        prefix: list[tuple] = []  # of the base: (node, parent, words) of its first turns
        paths: dict[int, list] = {}  # conversation -> its node so far, turns taken over
        out: list[tuple] = []

        def add(depth: int, node: bytes, parent: bytes | None, words: int, conv: int) -> None:
            levels.setdefault(depth, {}).setdefault(node, (parent, words, [], []))[2].append(conv)

        def hand_on(below: int | None) -> None:
            for depth in sorted(d for d in levels if below is None or d < below):
                for node, (parent, words, members, ends) in levels.pop(depth).items():
                    out.append((*halves(node), *halves(parent), depth, words, members, ends))

        for batch in batches:
            for base, side, place, conv, shared, last, digest, words in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if base != family or not started:
                    hand_on(None)
                    family, started, prefix, paths = base, True, [], {}
                if side == 0:
                    parent = prefix[-1][0] if prefix else ROOT
                    prefix.append((xxhash.xxh3_128_digest(parent + digest), parent, words))
                    continue
                if place == 1:
                    taken = min(shared, len(prefix))
                    add(0, ROOT, None, 0, conv)
                    for depth, step in enumerate(prefix[:taken], 1):
                        add(depth, *step, conv)
                    paths[conv] = [prefix[taken - 1][0] if taken else ROOT, taken]
                path = paths[conv]
                depth = path[1] + max(0, place - shared)
                if place > shared:
                    parent, path[0] = path[0], xxhash.xxh3_128_digest(path[0] + digest)
                    add(depth, path[0], parent, words, conv)
                if last:
                    levels[depth][path[0]][3].append(conv)
                    del paths[conv]
                hand_on(place - most_shared)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        hand_on(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return placed.mapInArrow(run, "k1 long, k2 long, p1 long, p2 long, depth long, words long, members array<long>, ends array<long>")


def end_hashes(family: DataFrame) -> DataFrame:
    """k1, k2 and ends_sha256, of the ascending, comma-joined ids that end in a node."""
    ended = family.where(F.size("ends") > 0).select(*KEY, F.explode("ends").alias("conv"))
    spans = ended.groupBy(*KEY, F.shiftright("conv", SPAN_BITS).alias("span")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == (k1, k2):
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"])

    return spans.repartition(*KEY).sortWithinPartitions(*KEY, "span").select(*KEY, "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, id_col: str, base: Column, shared: Column, most_shared: int, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node: id_col (its smallest member), depth, the parent's, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    base: the id of the conversation that a row's conversation begins like; shared: how
    many of its first turns, at most most_shared."""
    family = cut(family_nodes(placed_turns(turns, id_col, base, shared, most_shared, turn, role, text), most_shared))
    nodes = family.groupBy(*KEY).agg(
        F.min(F.array_min("members")).alias("conv"), F.sum(F.size("members")).alias("n_convs"),
        *[F.first(c).alias(c) for c in ("p1", "p2", "depth", "words")],
    )
    nodes = cut(nodes)
    children = cut(nodes.where(F.col("p1").isNotNull()).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "leaf": F.col("n_children").isNull().cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    nodes = cut(nodes)
    owners = nodes.groupBy("conv").agg(F.min("depth").alias("from"), F.sum("saved").alias("others_saved"), F.sum("leaf").alias("others_leaves"))
    passing = family.select(*KEY, "depth", F.explode("members").alias("conv")).join(owners, "conv").where(F.col("depth") < F.col("from"))
    passing = passing.groupBy(*KEY).agg(F.sum("others_saved").alias("others_saved"), F.sum("others_leaves").alias("others_leaves"))
    rest = Window.partitionBy("conv").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = nodes.withColumns({"saved": F.sum("saved").over(rest), "leaves": F.sum("leaf").over(rest)})
    summed = summed.join(passing, KEY, "left").join(end_hashes(family), KEY, "left")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    hot = hot_keys(children, "k1", "n_children")
    out = spread_join(summed, parents, ["p1", "p2"], hot, ["k1"], "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        F.col("conv").alias(id_col), "depth", F.col("parent").alias(f"parent_{id_col}"), "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("others_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("others_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
