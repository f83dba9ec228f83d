"""Grids of the driver's tables. Scans read only the columns that a grid needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.grid import GridFrame
from gridframe.sources.create import from_sums, from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def length(df: DataFrame, key: str) -> int:
    """The extent of an axis of dense keys from 0: read from file statistics."""
    return int(df.agg(F.coalesce(F.max(key) + 1, F.lit(0))).first()[0])


def vector(spark: SparkSession, sf_dir: str, name: str, key: str, value: str, **options) -> GridFrame:
    df = table(spark, sf_dir, name)
    return from_table(df, [key], F.col(value), (length(df, key),), **options)


def orders_cents(spark: SparkSession, sf_dir: str, **options) -> GridFrame:
    """o_orderkey -> total price in cents."""
    df = table(spark, sf_dir, "orders")
    return from_table(df, ["o_orderkey"], F.round(F.col("o_totalprice") * 100).cast("long"), (length(df, "o_orderkey"),), **options)


def quantity_grid(spark: SparkSession, sf_dir: str, **options) -> GridFrame:
    """(quantity 1-50, discount 0.00-0.10) -> sum of extended prices in cents."""
    df = table(spark, sf_dir, "lineitem")
    cells = [F.col("l_quantity").cast("long") - 1, F.round(F.col("l_discount") * 100).cast("long")]
    return from_sums(df, cells, F.round(F.col("l_extendedprice") * 100).cast("long"), (50, 11), "int64", **options)


def month_cube(spark: SparkSession, sf_dir: str, **options) -> GridFrame:
    """(ship month of the year, line number 1-7, status O/F) -> number of lines."""
    df = table(spark, sf_dir, "lineitem")
    cells = [F.month("l_shipdate") - 1, F.col("l_linenumber") - 1, F.when(F.col("l_linestatus") == "O", 0).otherwise(1)]
    return from_sums(df, cells, F.lit(1).cast("long"), (12, 7, 2), "int64", **options)


def embedding_matrix(spark: SparkSession, sf_dir: str, **options) -> GridFrame:
    """(vec_id, component) -> float32."""
    df = table(spark, sf_dir, "embeddings")
    n = length(df, "vec_id")
    wide = int(df.select(F.size("embedding")).first()[0])
    rows = df.select("vec_id", F.posexplode("embedding").alias("c", "x"))
    return from_table(rows, ["vec_id", "c"], F.col("x"), (n, wide), "float32", **options)
