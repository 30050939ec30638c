"""Class evidence, confidence and life cycle of tracks, and run reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The stages a timing report lists, in order.
STAGES = ("io", "detection", "sam_encoder", "sam_decoder", "projection", "fusion", "finalize", "write")


def class_history(detections: DataFrame, track: str, class_col: str, confidence: str, order: str) -> DataFrame:
    """Per track and class: summed confidence (negative counts as none), observations and first place."""
    return detections.groupBy(track, class_col).agg(
        F.sum(F.greatest(F.col(confidence), F.lit(0.0))).alias("score"),
        F.count("*").alias("n"),
        F.min(order).alias("first_order"),
    )


def score_maps(history: DataFrame, track: str, class_col: str) -> DataFrame:
    """Each track's scores as a map with text keys; a track has a bounded vocabulary."""
    entries = F.collect_list(F.struct(F.col(class_col).cast("string").alias("k"), F.col("score").alias("v")))
    return history.groupBy(track).agg(F.map_from_entries(F.sort_array(entries)).alias("semantic_scores"))


def dominant_class(history: DataFrame, track: str, class_col: str) -> DataFrame:
    """The class with the highest score; of equal scores the one seen first."""
    best = F.max_by(F.struct(class_col, "score"), F.struct(F.col("score"), -F.col("first_order")))
    return history.groupBy(track).agg(best.alias("b")).select(track, F.col(f"b.{class_col}").alias(class_col), F.col("b.score").alias("score"))


def class_shares(history: DataFrame, track: str, class_col: str) -> DataFrame:
    """The share of each class in its track's score; equal shares if nothing was scored."""
    total = history.groupBy(track).agg(F.sum("score").alias("total"), F.count("*").alias("classes"))
    share = F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(1.0 / F.col("classes"))
    return history.join(total, track).select(track, class_col, share.alias("share"))


def track_summary(detections: DataFrame, track: str, confidence: str, stamp: str, least: int) -> DataFrame:
    """Mean confidence, observations, first and last stamp and status per track."""
    return detections.groupBy(track).agg(
        F.avg(confidence).alias("confidence"),
        F.count("*").alias("observations"),
        F.min(stamp).alias("first_seen"),
        F.max(stamp).alias("last_seen"),
        F.when(F.count("*") >= least, F.lit("confirmed")).otherwise(F.lit("candidate")).alias("status"),
    )


def merged_summary(tracks: DataFrame, group: str) -> DataFrame:
    """Tracks of a group as one: means weighted by observations, sums, earliest and latest."""
    n = F.col("observations")
    return tracks.groupBy(group).agg(
        (F.sum(F.col("confidence") * n) / F.sum(n)).alias("confidence"),
        F.sum(n).alias("observations"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def lives(sightings: DataFrame, track: str, frame: str, max_missed: int, least: int) -> DataFrame:
    """Stretches in which a track is never missed for more than ``max_missed`` frames before it is confirmed.

    Numbers stretches from 1; a candidate that is missed longer ends, and its next
    sighting opens a new stretch. A stretch of ``least`` sightings is confirmed and
    never ends by missing, so it takes in everything after it.
    """
    order = W.partitionBy(track).orderBy(frame)
    gap = F.col(frame) - F.lag(frame).over(order) - 1
    broken = sightings.withColumn("_cut", F.coalesce((gap > max_missed).cast("int"), F.lit(0)))
    island = broken.withColumn("_island", F.sum("_cut").over(order.rowsBetween(W.unboundedPreceding, 0)))
    within = island.withColumn("_k", F.row_number().over(W.partitionBy(track, "_island").orderBy(frame)))
    reached = F.min(F.when(F.col("_k") >= least, F.col("_island"))).over(W.partitionBy(track))
    number = F.least(F.col("_island"), F.coalesce(reached, F.col("_island")))
    return within.withColumn("_life", number + 1).groupBy(track, F.col("_life").cast("long").alias("life")).agg(
        F.min(frame).alias("first_frame"),
        F.max(frame).alias("last_frame"),
        F.count("*").alias("sightings"),
        F.when(F.count("*") >= least, F.lit("confirmed")).otherwise(F.lit("candidate")).alias("status"),
    )


def throttled(rows: DataFrame, stamp: str, interval: int, by: Sequence[str]) -> DataFrame:
    """Stamps at which a snapshot is emitted: the first, then each at least ``interval`` after the last emitted.

    The choice is sequential: stamps of a key stream by in order, and only the last emitted
    one is held. Repeated stamps count once; null stamps go.
    """
    if interval <= 0:
        return rows.select(*by, stamp)

    def run(batches):
        key, last = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            keys = list(zip(*[batch[c] for c in by], strict=True)) if by else [()] * len(batch)
            for i, (k, t) in enumerate(zip(keys, batch[stamp].to_numpy(), strict=True)):
                if k != key or t - last >= interval:
                    key, last, keep[i] = k, t, True
            yield batch[keep]

    stamps = rows.select(*by, F.col(stamp).cast("long").alias(stamp)).where(F.col(stamp).isNotNull())
    dealt = stamps.repartition(*by) if by else stamps.coalesce(1)
    return dealt.sortWithinPartitions(*by, stamp).mapInPandas(run, stamps.schema)


def removed(previous: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that were there before and are gone: markers to delete, files to drop."""
    return previous.select(*key).distinct().join(current.select(*key), list(key), "left_anti")


def timing_report(events: DataFrame, stages: Sequence[str], elapsed: float, frames: int, stage: str = "stage", seconds: str = "seconds", calls: str = "calls") -> DataFrame:
    """One row per stage (zero if it never ran): seconds, share of elapsed time, per call and per frame."""
    spark = events.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("position", stage))
    sums = events.groupBy(stage).agg(F.sum(seconds).alias("total"), F.sum(calls).alias("n"))
    t, n = F.coalesce("total", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return listed.join(sums, stage, "left").select(
        "position",
        stage,
        F.round(t, 6).alias("total_seconds"),
        F.round(100 * t / elapsed, 3).alias("share_percent") if elapsed > 0 else F.lit(0.0).alias("share_percent"),
        n.cast("long").alias("calls"),
        F.round(F.coalesce(F.try_divide(1000 * t, n), F.lit(0.0)), 3).alias("avg_ms_per_call"),
        F.round(1000 * t / frames, 3).alias("avg_ms_per_frame") if frames > 0 else F.lit(0.0).alias("avg_ms_per_frame"),
    )


def timing_totals(report: DataFrame, elapsed: float) -> DataFrame:
    """Accounted, unaccounted and overlapped seconds; the last two are never negative."""
    total = F.sum("total_seconds")
    return report.agg(
        F.lit(float(elapsed)).alias("elapsed_seconds"),
        total.alias("accounted_seconds"),
        F.greatest(F.lit(0.0), F.lit(float(elapsed)) - total).alias("unaccounted_seconds"),
        F.greatest(F.lit(0.0), total - F.lit(float(elapsed))).alias("overlapped_seconds"),
    )


def top_objects(objects: DataFrame, limit: int, least: int = 1, classes: Sequence[str] = (), confirmed: bool = False) -> DataFrame:
    """The most observed objects, ties by track id; filters first."""
    out = objects.where(F.col("observations") >= least)
    if classes:
        out = out.where(F.col("class_name").isin(list(classes)))
    if confirmed:
        out = out.where("status = 'confirmed'")
    return out.orderBy(F.desc("observations"), "track_id").limit(limit)
