"""Counters of a run, gathered in the pass that does the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RunCounters:
    """Counts rows where they pass: no table is scanned again for its numbers.

    ``watch`` marks a place in a plan; once an action has run the plan, ``counts`` has its
    numbers. A plan that holds a place twice (a join with itself) counts its rows twice.
    """

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **more: Column) -> DataFrame:
        """``df``, whose rows count as ``stage``; ``more`` names further aggregates, as ``{stage}_{name}``."""
        if stage in self.seen:
            raise ValueError(f"{stage} is watched already")
        self.seen[stage] = Observation()
        return df.observe(self.seen[stage], F.count(F.lit(1)).alias(stage), *[c.alias(f"{stage}_{n}") for n, c in more.items()])

    def counts(self) -> dict[str, int]:
        """All numbers so far; waits for the first action of every watched plan."""
        return {name: n for o in self.seen.values() for name, n in o.get.items()}

    def row(self, spark: SparkSession) -> DataFrame:
        """The numbers as one row."""
        found = self.counts()
        return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in found.items()])
