"""The end of a run: denoised clouds, merged doubles, confirmed objects, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelar.config import MapConfig
from voxelar.functions.detection import status
from voxelar.functions.geometry import AXES
from voxelar.plans.components import connected_components
from voxelar.plans.cut import materialize

from .spatial import box_pairs, cloud_bounds, largest_cluster, radius_hits
from .voxels import voxel_mean


def double_tracks(points: DataFrame, track: str, class_col: str, order: str, config: MapConfig) -> DataFrame:
    """``(track, survivor)`` of tracks of one class whose clouds nearly coincide; the smallest id survives.

    Boxes and centroids name the pairs whose points are compared; others never meet.
    """
    bounds = cloud_bounds(points, [track, class_col])
    near = box_pairs(bounds, track, config.overlap_radius, config.max_centroid_distance, [class_col])
    pairs = near.select(F.col(f"a_{track}").alias("a"), F.col(f"b_{track}").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pts = points.select(track, order, *AXES)
    left, right = (both.join(pts.withColumnRenamed(track, k), k) for k in "ab")
    hits = radius_hits(left, right, config.overlap_radius, ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("hits"))
    shares = hits.join(bounds.select(F.col(track).alias("a"), "n"), "a").select("a", "b", (F.col("hits") / F.col("n")).alias("share"))
    found = connected_components(shares.where(F.col("share") >= config.merge_overlap).select("a", "b"))
    return found.select(F.col("node").alias(track), F.col("component").alias("survivor"))


def finalize(points: DataFrame, tracks: DataFrame, track: str, class_col: str, order: str, config: MapConfig) -> tuple[DataFrame, DataFrame]:
    """Denoised and merged clouds ``(track, x, y, z)`` and the confirmed tracks.

    ``tracks``: ``track, class, confidence, observations, first_seen, last_seen``.
    ``order`` numbers the points uniquely over all tracks.
    """
    kept = largest_cluster(points, config.cluster_eps, config.cluster_min_points, order, [track])
    clean = materialize(points.join(kept.where("kept").select(order), order, "left_semi"), "denoised")
    doubles = materialize(double_tracks(clean, track, class_col, order, config), "doubles")

    def renamed(df: DataFrame) -> DataFrame:
        return df.join(doubles, track, "left").withColumn(track, F.coalesce("survivor", track)).drop("survivor")

    n = F.col("observations")
    merged = renamed(tracks).groupBy(track).agg(
        F.min_by(class_col, "first_seen").alias(class_col),
        (F.sum(F.col("confidence") * n) / F.sum(n)).alias("confidence"),
        F.sum(n).alias("observations"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )
    confirmed = merged.withColumn("status", status(n, config.min_confirmed)).where("status = 'confirmed'")
    cloud = voxel_mean(renamed(clean), config.voxel_size, [track])
    return cloud.join(confirmed.select(track), track, "left_semi").select(track, *AXES), confirmed


def ascending(rows: DataFrame, key: str, order: str, by: Sequence[str]) -> DataFrame:
    """Per group whether its keys strictly ascend in stored order."""
    before = F.lag(key).over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("_up", before.isNull() | (F.col(key) > before)).groupBy(*by).agg(F.bool_and("_up").alias("ascending"))


def projection_counters(points: DataFrame, by: Sequence[str], voxel: float) -> DataFrame:
    """Raw points and occupied voxels per projected object."""
    cells = voxel_mean(points, voxel, by)
    return cells.groupBy(*by).agg(F.sum("n").alias("raw_points"), F.count("*").alias("voxel_points"))


def frame_stem(sec, nanosec):
    """File stem of a stamp: seconds and nine digits of nanoseconds."""
    return F.concat_ws("_", sec.cast("string"), F.lpad(nanosec.cast("string"), 9, "0"))


def detection_ids(points: DataFrame, detection: str, by: Sequence[str]) -> DataFrame:
    """The distinct detections of every cloud as rows, with their ascending ``position`` from 0; points without one do not count."""
    ids = points.where(F.col(detection).isNotNull()).select(*by, detection).distinct()
    return ids.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(detection)).cast("long") - 1)
