"""The bounded sample of labelled rows that a classifier is fitted on. Cases: rows
without an id or label are left out; of an id's labels the greatest counts; an empty
table gives an empty sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import cut


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def training_sample(labels: DataFrame, label: str, learn: Column, limit: int, id_col: str = "doc_id") -> DataFrame:
    """__doc and __label of at most `limit` labelled rows for which `learn` holds,
    the same at every run: those whose hashed ids are least. An id with several
    labels keeps the greatest."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learn)
    rows = rows.groupBy(F.col(id_col).cast("long").alias("__doc")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    return cut(rows.orderBy(F.xxhash64("__doc"), "__doc").limit(limit))
