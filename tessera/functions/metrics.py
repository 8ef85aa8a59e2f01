"""Counters of what a process has done, taken from jobs as they run.

A counter is an aggregate that Spark computes beside a job's own work (``DataFrame.observe``),
so counting costs no job of its own, and failed attempts of tasks count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Counters:
    """Counters by stage. A stage may be watched again: what it counts adds up."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, stage: str, **metrics: Column) -> DataFrame:
        """``df``, of whose rows the first job that reads all of them also takes ``metrics``."""
        seen = Observation()
        self.seen.append((stage, seen))
        return df.observe(seen, *[c.alias(name) for name, c in metrics.items()])

    def totals(self) -> dict[tuple[str, str], int]:
        """Waits for jobs that are under way; every watched DataFrame must have been read."""
        out: dict[tuple[str, str], int] = {}
        for stage, seen in self.seen:
            for name, value in seen.get.items():
                out[stage, name] = out.get((stage, name), 0) + int(value or 0)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, metric, value), a row a counter."""
        return spark.createDataFrame([(s, m, v) for (s, m), v in sorted(self.totals().items())], "stage string, metric string, value long")
