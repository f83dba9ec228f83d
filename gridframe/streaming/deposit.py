"""Particle deposition on a stream: running sums by cell, with late data bounded.

The sums are those of a batch deposit; on a stream the cells are kept as state,
for each event-time window if one is given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deposit_stream(rows: DataFrame, cells: Sequence[Column], weight: Column, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Sums of weights by cell (and window of `time`), as a streaming aggregation."""
    keys = [c.cast("long").alias(f"i{k}") for k, c in enumerate(cells)]
    if time is not None:
        rows = rows.withWatermark(time, late)
        if window is not None:
            keys.append(F.window(time, window).alias("window"))
    return rows.groupBy(*keys).agg(F.sum(weight).alias("v"))
