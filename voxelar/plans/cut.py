"""Cutting lineage through a table in the cluster's shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import settings

#: Rows up to which a side may be broadcast; above it the plan falls back to a shuffle join.
BROADCAST_ROWS = 20_000
#: Whether sides of a join that are dealt by some of its keys are shuffled again by all of them.
DEAL_AGAIN = "spark.sql.requireAllClusterKeysForCoPartition"
#: Drops a command's shuffle files when it ends; Spark keeps them otherwise until the driver collects its plan as garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for local masters that set none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="voxelar-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "cut", together: bool = False) -> DataFrame:
    """Write ``df`` once to shared storage and read it back, so later stages never recompute it.

    Unlike a cached or locally checkpointed frame the files outlive any executor, and
    the columnar copy still allows column pruning and filter pushdown. What the write
    shuffled is dropped with it, so a chain of cuts needs the disk of its largest step.
    ``together``: sides of a join that are dealt by some of its keys stay where they are.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {SHUFFLE_CLEANUP: "true"} | ({DEAL_AGAIN: "false"} if together else {})):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups of ``by`` whole in a task, in as many parts as shuffles have: rows that are copied afterwards are more than Spark knows of when it merges small parts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when it has at most ``limit`` rows, else ``df`` for a shuffle join.

    The check itself stops after ``limit`` + 1 rows, so it never counts a large table.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
