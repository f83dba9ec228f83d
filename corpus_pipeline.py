"""A corpus pipeline: from documents to packed windows of token ids.

Each stage takes all that the one before kept, and all but the last return the
columns of documents. run() writes every stage's result as Parquet in the shared
folder and reads it again, which cuts lineage and survives lost executors. Cases:
documents without text fail the rules; a null source is a host and a source of its
own; documents without an id are kept like others until packing, which gives their
pieces a null id; repeated rows are copies, of which one stays; an empty table gives
no rows at every stage, and further columns stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridframe.llm import boosting, mixing, near_dups, packing, rules
from gridframe.llm.common import staged_path, table
from gridframe.llm.labelled import fold, training_sample
from gridframe.llm.queries import QUALITY_ROWS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, and every rule where their host is strict."""
    return rules.kept_documents(docs, "source")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees score 0.5 or more."""
    training = training_sample(table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1, QUALITY_ROWS)
    return boosting.kept_documents(docs, training, 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return near_dups.one_of_each(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the sources' weights, a row for each copy taken."""
    sized = docs.withColumn("__words", mixing.word_count())
    return mixing.mixture(sized, "__words").drop("__words")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in windows of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: Trained scores and token ids can't be expressed in SQL; the tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = staged_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
