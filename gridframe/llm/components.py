"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import cut, hot_keys, remove_path, spread_join, staged_path


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected with, for every node of
    edges(a, b) but the roots themselves.

    Each round points the larger neighbours of every node at its smallest one,
    then does the same among the smaller ones, until every edge leads to a root.
    Minima are aggregated before they are shuffled; where they are joined back, the
    edges of a hub are dealt over salts. The edge table doesn't grow. Loops, repeated
    edges and edges in both directions count once; empty edges give no rows, and
    nodes must not be null.

    Each round's edges are a written table in the shared folder, deleted once the next
    one stands. A checkpoint keeps the plan's estimate of its size, which the joins of
    every round would raise to a power, until the driver multiplies numbers of millions
    of digits; a table has its true size.
    """
    spark = edges.sparkSession

    def written(e: DataFrame) -> tuple[DataFrame, str]:
        path = staged_path(spark, "edges")
        e.write.parquet(path)
        return spark.read.schema(e.schema).parquet(path), path

    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    (e, path), seen = written(e), None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen or not state[0]:
            out = cut(e.select(F.col("a").alias("node"), F.col("b").alias("root")))
            remove_path(spark, path)
            return out
        seen, ends = state, 2 * state[0]
        both = e.union(e.select("b", "a"))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        large = spread_join(both, low.drop("n"), ["a"], hot_keys(low, "a", "n", ends), ["b"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = cut(large)
        low = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, low.drop("n"), ["a"], hot_keys(low, "a", "n", ends), ["b"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        old = path
        e, path = written(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct())
        remove_path(spark, old)
