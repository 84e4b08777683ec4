"""Counts of the stages of a job, taken by the job itself."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageCounts:
    """Rows of each watched table, counted while some action computes it: no
    second pass, no second scan.

    A table counts in the first action that computes it, so watch it where one
    action does (before a written table).  Watch the action's last stage (after
    its last shuffle): Spark counts the partitions of a last stage once, but an
    earlier stage that is computed again for a lost executor counts again.
    """

    def __init__(self):
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
        """``df``, with its rows counted as ``stage``; ``counts`` names further
        conditions, each the stage of that name."""
        seen = Observation()
        conditions = {stage: F.lit(True), **(counts or {})}
        self._seen += [(name, seen) for name in conditions]
        return df.observe(seen, *[F.count_if(c).alias(name) for name, c in conditions.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        """``(stage, n_rows)`` in the order watched; waits for the actions."""
        rows = [(name, int(seen.get[name])) for name, seen in self._seen]
        return spark.createDataFrame(rows, "stage string, n_rows long")
