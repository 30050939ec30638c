"""Stamp joins whose late and unmatched rows are kept apart with a reason instead of vanishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGGED = "side string, stamp_ns long, ref long, late boolean"
_MARKS = "number long, stamp_ms long"


def flagging(spark: SparkSession, staged: str, marks: str, delay_ms: int) -> Callable[[DataFrame, int], None]:
    """A sink of batches (``joins.snapshots``) that writes their ``side, stamp_ns, ref, late``, each batch to a folder of its number in ``staged``.

    A batch: ``side``, ``stamp_ns``, ``ref``. A row is late if an earlier batch has seen a stamp
    ``delay_ms`` after it (to the millisecond). Every batch leaves its highest stamp in
    ``marks``; one that is repeated looks at those of lower numbers and replaces its folder
    by the same rows, so a reader must not start on a batch before it has its mark.
    """
    spark.range(0).select(F.col("id").alias("number"), F.col("id").alias("stamp_ms")).write.mode("ignore").parquet(marks)
    ms = F.expr("stamp_ns div 1000000")

    def sink(batch: DataFrame, number: int) -> None:
        own, path = batch.sparkSession, f"{staged}/{number}"
        seen = own.read.schema(_MARKS).parquet(marks).where(F.col("number") < number).agg(F.max("stamp_ms")).first()[0]
        late = F.lit(False) if seen is None else ms <= seen - delay_ms
        batch.select("side", "stamp_ns", "ref", late.alias("late")).write.mode("overwrite").parquet(path)
        top = own.read.schema(FLAGGED).parquet(path).agg(F.lit(number).cast("long").alias("number"), F.max(ms).alias("stamp_ms"))
        top.write.mode("append").parquet(marks)

    return sink


def flagged(spark: SparkSession, staged: str, stream: bool = False) -> DataFrame:
    """The rows that ``flagging`` has written, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(FLAGGED).option("recursiveFileLookup", "true").parquet(staged)


def paired(rows: DataFrame, delay: str) -> DataFrame:
    """Clouds and metadata of equal stamps of a stream of punctual rows (``flagged``), the unmatched with nulls once the watermark has passed them.

    A full outer join of the two sides; each row leaves its state matched or expired.
    """
    at = F.timestamp_micros(F.expr("stamp_ns div 1000"))
    sides = [
        rows.where((F.col("side") == side) & ~F.col("late")).select(F.col("stamp_ns").alias(f"{p}_ns"), F.col("ref").alias(f"{p}_ref"), at.alias(f"{p}_ts")).withWatermark(f"{p}_ts", delay)
        for side, p in (("cloud", "c"), ("meta", "m"))
    ]
    same = (F.col("c_ts") == F.col("m_ts")) & (F.col("c_ns") == F.col("m_ns"))
    joined = sides[0].join(sides[1], same, "full_outer")
    outcome = F.when(F.col("c_ns").isNull(), "no cloud").when(F.col("m_ns").isNull(), "no metadata").otherwise("matched")
    return joined.select(F.coalesce("c_ns", "m_ns").alias("stamp_ns"), "c_ref", "m_ref", outcome.alias("outcome"))


def outcomes(staged: DataFrame, pairs: DataFrame) -> DataFrame:
    """What became of every row so far, ``side, ref, stamp_ns, outcome``: ``late``, ``matched``, ``no cloud``, ``no metadata``; others still wait."""
    late = staged.where("late").select("side", "ref", "stamp_ns", F.lit("late").alias("outcome"))
    done = [pairs.where(f"{p}_ref is not null").select(F.lit(side).alias("side"), F.col(f"{p}_ref").alias("ref"), "stamp_ns", "outcome") for side, p in (("cloud", "c"), ("meta", "m"))]
    return late.unionByName(done[0]).unionByName(done[1])
