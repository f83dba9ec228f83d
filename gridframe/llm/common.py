"""What the corpus operators share: words, tables, lineage cuts, joins that spread
hot keys, size-checked broadcasts. Cases: null keys join nothing and are never hot;
empty tables have no hot keys; null texts are slices of no bytes; an empty batch
gives no slice."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
SPACES = " \t\n\v\f\r"

#: Tables of at most so many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    folder of our own where the session names none and runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="gridframe-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a table that Spark writes."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: smaller than a
    checkpoint for tables of many narrow rows."""
    path = staged_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint, if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: A key of more than this share of the rows, and of at least so many, is hot. So
#: there are at most HOT_KEYS of them, which may be collected.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 1000, 64


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None) -> list:
    """The values of `key` in counts(key, n, ...), a row for each key, that are hot.
    total: the sum of n, or more, where it is known."""
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    return list({r[0] for r in counts.where(F.col(n) > max(HOT_ROWS, total // HOT_KEYS)).select(key).collect()})


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], hot: list, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with side (few rows a key). Rows whose first key is hot are dealt
    over SALTS by the columns `by`, and the side's rows are repeated for each salt."""
    if not hot:
        return rows.join(side, keys, how)
    is_hot = F.col(keys[0]).isin(hot)
    rows = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int"))
    side = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, SALTS - 1).otherwise(0))))
    return rows.join(side, [*keys, "__salt"], how).drop("__salt")


def text_or_empty(column: str = "text") -> "F.Column":
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], columns: Iterable[str], budget: int = 1_500_000, text: str = "text") -> Iterator[dict]:
    """Python lists of the named columns, a run of rows at a time, cut so that a
    run's texts hold about `budget` bytes (one longer text is a run of its own)."""
    columns = list(columns)
    for batch in batches:
        sizes = batch.column(text)
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
        for end, n in enumerate(lengths):
            if held + n > budget and end > start:
                part = batch.slice(start, end - start)
                yield {c: part.column(c).to_pylist() for c in columns}
                start, held = end, 0
            held += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield {c: part.column(c).to_pylist() for c in columns}
