"""Paths that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder, or under a temporary one
    where the session names none (single-machine tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="gridframe-")
    return f"{root.removeprefix('file://').rstrip('/')}/{uuid.uuid4().hex}/{name}"
