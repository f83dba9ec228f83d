"""Profiling regions: what operators read and how many jobs a stretch of code ran.

Off unless a Profile is entered: then the frames of reductions, selections, scans and
stencils count their rows as they are computed, by Spark's observed metrics, and the
jobs of a region run under its name, which Spark's UI and event log show as their group.

    with Profile(spark) as p:
        with p.region("energy"):
            total = (a * a).sum()
    p.rows(), p.jobs("energy")
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_active: list[Profile] = []
GROUP, DESCRIPTION = "spark.jobGroup.id", "spark.job.description"


class Profile:
    def __init__(self, spark: SparkSession):
        self.spark, self.observed = spark, []

    def __enter__(self) -> Profile:
        _active.append(self)
        return self

    def __exit__(self, *_) -> None:
        _active.remove(self)

    @contextmanager
    def region(self, name: str) -> Iterator[None]:
        """Jobs that start within run as the group `name`."""
        sc = self.spark.sparkContext
        before = [sc.getLocalProperty(k) for k in (GROUP, DESCRIPTION)]
        sc.setJobGroup(name, name)
        try:
            yield
        finally:
            for k, v in zip((GROUP, DESCRIPTION), before):
                sc.setLocalProperty(k, v)

    def jobs(self, name: str) -> int:
        """Jobs that the region has run, of those that Spark still remembers."""
        return len(self.spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    def rows(self) -> dict[str, int]:
        """Rows that operators have read, by operator: of frames computed so far."""
        out: dict[str, int] = {}
        for name, seen in self.observed:
            if seen._jo.future().isCompleted():  # else get would wait for a frame that isn't computed
                out[name] = out.get(name, 0) + seen.get["rows"]
        return out


def watched(rows: DataFrame, name: str) -> DataFrame:
    """rows, counted as what the operator `name` reads if a profile is on."""
    for profile in _active:
        seen = Observation()
        profile.observed.append((name, seen))
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    return rows
