"""Mixing sources to target weights by weighted fair queueing.

Every document, in a shuffled order within its source, gets a virtual finish
time: the source's tokens up to and including it, divided by the source's
target. Emitting documents in order of finish time serves every source in
proportion to its target at every moment; the order is cut where the running
total of tokens reaches the budget. A source whose target exceeds its size runs
through its documents again (an epoch), up to `max_epochs` times.

Scale: the running totals are two-level. A source's documents fall into 4096
hash ranges; range totals are summed first, and a window runs within one range
only, so a source that holds a third of all rows is no hot key. The global cut
is found by two rounds of 4096 equal slots of virtual time (in which work is
even, as fair queueing spreads tokens evenly over virtual time) and a sort of
the one sub-slot where the budget ends. Texts aren't read, only their sizes. The
mix itself is then sorted by finish time over range partitions and written in that
order. Sources are a table of one row each, ranked in one task: some millions of
sources are within its bounds.

Cases: a null text has size 0; documents of size 0 are never taken and keep
taken = 0; null is a source of its own, sorted last; a null id is shuffled as an
empty one. Rows of one source, id and size have equal finish times but for their
turn: each counts as a row of its own, and where the budget ends among them any of
them may be the last one taken. An empty table gives no rows. Further columns stay
as they are; names that this operator uses itself are all prefixed with `__`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import WORD_PATTERN, cut, small_side

RANGES = 4096
SLOTS = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Rows (__source, __source_size, __rank, __target) of sizes(__source, __size).

    Sources in code-point order, null last, get the weights in turn and share the
    total by weight; a target stops at max_epochs times its source's size, and
    what is above goes to the others by weight. With sources sorted by cap/weight,
    those at their cap come first, so one pass over running sums finds the level.
    The windows run over one row a source, not over documents.
    """
    by_source = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    ordered = Window.orderBy(F.col("__source").asc_nulls_last())
    ranked = by_source.withColumn("__rank", F.row_number().over(ordered))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("__weight", F.element_at(cycle, ((F.col("__rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("__cap", F.col("__source_size") * max_epochs)
    ranked = ranked.withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    level = Window.orderBy("__ratio", "__rank")
    before, after, everything = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    ranked = ranked.withColumn("__total", F.sum("__source_size").over(everything))
    ranked = ranked.withColumn(
        "__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__weight").over(after)
    ).withColumn("__capped", F.col("__level") >= F.col("__ratio"))
    ranked = ranked.withColumn("__open", F.min(F.when(~F.col("__capped"), F.struct("__ratio", "__rank", "__level"))).over(everything))
    return ranked.select(
        "__source", "__source_size", "__rank", "__total",
        F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(F.col("__open.__level") * F.col("__weight")).alias("__target"),
    )


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("__source_size") + F.col("__cum")) / F.col("__target")


def _key(epoch: Column) -> Column:
    return F.struct(_finish(epoch).alias("finish"), F.col("__rank").alias("rank"), epoch.cast("int").alias("epoch"), F.col("__hash").alias("hash"), F.col("__id").cast("string").alias("id"))


def queued(docs: DataFrame, targets: DataFrame, size_col: str, source: str, id_col: str, seed: int) -> DataFrame:
    """docs with __size, __source_size, __target, __total and __cum, the tokens of
    the source up to and with each document in shuffled order."""
    keyed = docs.withColumns({"__id": F.col(id_col), "__source": F.col(source), "__size": F.col(size_col)})
    keyed = keyed.join(targets, F.col("__source").eqNullSafe(F.col("__name")), "left").drop("__name")
    keyed = keyed.withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("__range", F.conv(F.substring("__hash", 1, 3), 16, 10).cast("int"))
    totals = keyed.groupBy("__rank", "__range").agg(F.sum("__size").alias("__here"))
    before = Window.partitionBy("__rank").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__rank", "__range", F.coalesce(F.sum("__here").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__rank", "__range").orderBy("__hash", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("__within", F.sum("__size").over(within))
    keyed = keyed.join(offsets, ["__rank", "__range"], "left")
    return keyed.withColumn("__cum", F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


def cut_point(queue: DataFrame, max_epochs: int) -> dict | None:
    """The key of the last copy within the budget (None: nothing is taken)."""
    first = queue.select("__total").first()
    if first is None or not first[0]:
        return None
    budget = first[0]
    copies = queue.where((F.col("__size") > 0) & (F.col("__target") > 0)).withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.withColumns({"__finish": _finish(F.col("__epoch")), "__key": _key(F.col("__epoch"))})
    low, high, taken = 0.0, float(max_epochs), 0
    for _ in range(2):
        here = copies.where(F.col("__finish").between(low, high))
        slot = F.floor((F.col("__finish") - F.lit(low)) / F.lit(high - low) * SLOTS).cast("int")
        over = None
        for row in here.groupBy(slot.alias("slot")).agg(F.sum("__size").alias("n"), F.min("__finish").alias("low"), F.max("__finish").alias("high")).orderBy("slot").collect():  # SLOTS + 1 rows at most
            if taken + row["n"] > budget:
                over = row
                break
            taken += row["n"]
        if over is None:
            return {"up_to": high}
        low, high = over["low"], over["high"]
        if low == high:
            break
    here = copies.where(F.col("__finish").between(low, high))
    run = here.select("__key", F.sum("__size").over(Window.orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    last = run.where(F.col("run") <= budget - taken).agg(F.max("__key").alias("k")).first()["k"]
    return {"last": last.asDict()} if last else {"below": low}


def _taken(point: dict | None, epoch: int) -> Column:
    if point is None:
        return F.lit(False)
    if "up_to" in point:
        return _finish(F.lit(epoch)) <= F.lit(point["up_to"])
    if "below" in point:
        return _finish(F.lit(epoch)) < F.lit(point["below"])
    last = F.struct(*[F.lit(v).alias(k) for k, v in point["last"].items()])
    return _key(F.lit(epoch)) <= last


def weighted_fair_mix(docs: DataFrame, size_col: str, source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """docs (size_col: a long, not null) with __copies, how often the mix takes
    each document, __finish, the virtual finish time of its first copy by which
    the mix is ordered, and __source_size, __target, __total."""
    small = cut(docs.select(*dict.fromkeys([id_col, source, size_col])))
    named = small.select(F.col(source).alias("__source"), F.col(size_col).alias("__size"))
    targets = cut(source_targets(named, weights, max_epochs)).withColumnRenamed("__source", "__name")
    targets = small_side(targets, targets.count())
    lean = cut(queued(small, targets, size_col, source, id_col, seed))
    point = cut_point(lean, max_epochs)
    queue = lean if {*docs.columns} == {*small.columns} else queued(docs, targets, size_col, source, id_col, seed)
    served = (F.col("__size") > 0) & (F.col("__target") > 0)
    copies = sum((F.when(_taken(point, e), 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    finish = F.when(F.col("__target") > 0, _finish(F.lit(0)))
    return queue.withColumns({"__copies": F.when(served, copies).otherwise(0).cast("int"), "__finish": finish}).drop("__id", "__source", "__size", "__hash", "__rank", "__cum")


def mixture(docs: DataFrame, size_col: str, **options) -> DataFrame:
    """The mix itself: docs' own columns, a row for each copy taken, in the order of
    finish times, over range partitions."""
    mixed = weighted_fair_mix(docs, size_col, **options).where(F.col("__copies") > 0)
    mixed = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    finish = F.col("__finish") + F.col("__copy") * F.col("__source_size") / F.col("__target")
    return mixed.withColumn("__at", finish).orderBy("__at", options.get("id_col", "doc_id")).select(*docs.columns)
