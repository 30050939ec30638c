"""Top-down layouts and object records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelar.functions.color import pack_rgb, stable_color
from voxelar.functions.detection import safe_name
from voxelar.functions.geometry import AXES, is_finite, to_pixel

from .spatial import cloud_bounds


def xy_bounds(points: DataFrame) -> DataFrame:
    """One row: finite XY bounds; an error when there is no finite point and the row is read."""
    fine = points.where(is_finite(F.col("x"), F.col("y")))
    found = fine.agg(*[f(F.col(a).cast("double")).alias(f"{p}_{a}") for a in ("x", "y") for p, f in (("min", F.min), ("max", F.max))])
    return found.select(*[F.coalesce(c, F.raise_error("points have no finite XY coordinates").cast("double")).alias(c) for c in found.columns])


def fit_layout(points: DataFrame, pixels_per_meter: float = 180.0, margin: float = 0.5, least: int = 700, most: int = 2400) -> DataFrame:
    """One row that maps metres to pixels: bounds with margin, scale, canvas and centring offsets."""
    if pixels_per_meter <= 0 or margin < 0 or least <= 0 or most < least:
        raise ValueError("invalid layout limits")
    b = xy_bounds(points)
    b = b.select(*[(F.col(f"min_{a}") - margin).alias(f"min_{a}") for a in "xy"], *[(F.col(f"max_{a}") + margin).alias(f"max_{a}") for a in "xy"])
    span = {a: F.greatest(F.col(f"max_{a}") - F.col(f"min_{a}"), F.lit(1e-3)) for a in "xy"}
    b = b.withColumn("scale", F.least(F.lit(float(pixels_per_meter)), *[(most - 1) / s for s in span.values()]))
    content = {a: s * F.col("scale") for a, s in span.items()}
    size = {n: F.ceil(F.greatest(F.lit(float(least)), content[a] + 1)).cast("int") for n, a in (("width", "x"), ("height", "y"))}
    b = b.withColumns(size)
    return b.withColumns({f"offset_{a}": (F.col(n) - 1 - content[a]) * 0.5 for n, a in (("width", "x"), ("height", "y"))})


def object_records(points: DataFrame, track: str, name: Column, source: str = "batch") -> DataFrame:
    """Centre, size, bounds and number of points of every object, with its id and label."""
    b = cloud_bounds(points, [track])
    return b.select(
        F.concat_ws("_", safe_name(name, key=True), F.col(track).cast("string")).alias("id"),
        F.col(track).alias("track_id"),
        name.alias("label"),
        F.lit(source).alias("source"),
        *[F.col(f"c_{a}").alias(a) for a in AXES],
        *[(F.col(f"hi_{a}") - F.col(f"lo_{a}")).alias(f"size_{a}") for a in AXES],
        *[F.col(f"{p}_{a}") for p in ("lo", "hi") for a in AXES],
        F.col("n").alias("point_count"),
    )


def full_records(
    points: DataFrame, tracks: DataFrame, scores: DataFrame, track: str, least: int, source: str = "batch", confirmed_only: bool = False
) -> DataFrame:
    """Every field of an object record under the names its readers expect: geometry, evidence, times, files, class scores.

    ``tracks``: ``track, class_id, class_name, confidence, observations, first_seen,
    last_seen, missed_frames``; ``scores``: ``track, semantic_scores``.
    """
    geometry = object_records(points, track, F.lit("")).drop("id", "label", "source").withColumnRenamed("track_id", track)
    wanted = tracks.where(F.col("observations") >= least) if confirmed_only else tracks
    joined = wanted.join(geometry, track).join(scores, track, "left")
    stem = F.concat(F.format_string("object_%04d_", F.col(track)), safe_name(F.col("class_name")))
    return joined.select(
        F.concat_ws("_", safe_name(F.col("class_name"), key=True), F.col(track).cast("string")).alias("id"),
        F.col("class_name").alias("label"),
        F.when(F.col("observations") >= least, F.lit("confirmed")).otherwise(F.lit("candidate")).alias("state"),
        F.lit(source).alias("source"),
        *AXES,
        *[f"size_{a}" for a in AXES],
        "confidence",
        F.col("observations").alias("times_seen"),
        "first_seen",
        "last_seen",
        F.col(track).alias("track_id"),
        "class_id",
        "class_name",
        F.array(*AXES).alias("centroid"),
        F.array(*[f"lo_{a}" for a in AXES]).alias("bounds_min"),
        F.array(*[f"hi_{a}" for a in AXES]).alias("bounds_max"),
        "point_count",
        F.concat(F.lit("objects/"), stem, F.lit(".ply")).alias("point_cloud_ply"),
        F.concat(F.lit("objects/"), stem, F.lit(".npz")).alias("point_cloud_npz"),
        "missed_frames",
        F.coalesce("semantic_scores", F.create_map().cast("map<string,double>")).alias("semantic_scores"),
    )


def xy_objects(points: DataFrame, track: str, **limits) -> DataFrame:
    """Per object its finite XY bounds and centre in metres and the centre's pixel in the common layout."""
    fine = points.where(is_finite(F.col("x"), F.col("y")))
    aggs = [f(F.col(a).cast("double")).alias(f"{p}{a}") for a in "xy" for p, f in (("lo_", F.min), ("hi_", F.max))]
    bounds = fine.groupBy(track).agg(*aggs, F.count("*").alias("n"))
    middle = {f"center_{a}": (F.col(f"lo_{a}") + F.col(f"hi_{a}")) * 0.5 for a in "xy"}
    placed = bounds.withColumns(middle).crossJoin(F.broadcast(fit_layout(points, **limits)))  # one row
    return placed.select(
        track, "n", *[f"{p}_{a}" for p in ("lo", "hi", "center") for a in "xy"], *[c.alias(k) for k, c in to_pixel(F.col("center_x"), F.col("center_y")).items()]
    )


def fused_cloud(points: DataFrame, tracks: DataFrame, track: str = "track_id") -> DataFrame:
    """Points of confirmed tracks with the fields of a fused cloud; points without a colour take their track's.

    ``points``: ``track, x, y, z`` and, if known, packed ``rgb``; ``tracks``: ``track, class_id,
    confidence, observations, status``.
    """
    own = F.coalesce(F.col("rgb"), pack_rgb(*stable_color(F.col(track)).values())) if "rgb" in points.columns else pack_rgb(*stable_color(F.col(track)).values())
    confirmed = tracks.where("status = 'confirmed'").select(track, "class_id", "confidence", "observations")
    return points.join(confirmed, track).select(*AXES, own.cast("long").alias("rgb"), track, "class_id", "confidence", "observations")


def run_summary(frames: DataFrame, detections: DataFrame, projected: DataFrame, objects: DataFrame, timing: DataFrame, elapsed: float) -> DataFrame:
    """The summary document of a run as one JSON row: counters of its tables and the timing report.

    ``frames``: ``frame_id``; ``timing`` as from ``timing_report``, which has a row per stage.
    """
    parts = [
        frames.agg(F.min("frame_id").alias("frame_start"), F.count("*").alias("frame_count"), F.max("frame_id").alias("frame_last")),
        *[df.agg(F.count("*").alias(n)) for df, n in ((detections, "input_detections"), (projected, "projected_detections"), (objects, "objects"))],
        timing.agg(F.sort_array(F.collect_list(F.struct(*timing.columns))).alias("timing")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(F.broadcast(part))  # one row each
    return row.select(F.to_json(F.struct(*row.columns, F.lit(round(elapsed, 3)).alias("elapsed_seconds"))).alias("value"))


def navigation_records(records: DataFrame, limit: int, least: int = 1, classes: Sequence[str] = (), source: str = "viewer_filtered") -> DataFrame:
    """Object records as a viewer shows them: filtered, the most observed first, at most ``limit`` (0: all)."""
    kept = records.where(F.col("times_seen") >= least)
    if classes:
        kept = kept.where(F.col("class_name").isin(list(classes)))
    kept = kept.withColumn("source", F.lit(source)).orderBy(F.desc("times_seen"), "track_id")
    return kept.limit(limit) if limit > 0 else kept


def marker_changes(previous: DataFrame, records: DataFrame, least_size: float = 0.02) -> DataFrame:
    """Markers to publish: box and label of every object, and deletions of ids that are gone.

    ``records``: ``track_id, state, class_name, times_seen, confidence, point_count`` with
    bounds ``lo_*``, ``hi_*``; ``previous``: the ids published before. Boxes of confirmed
    objects are less transparent.
    """
    boxes = records.select(
        F.col("track_id").alias("id"),
        F.lit("add").alias("action"),
        *[((F.col(f"lo_{a}") + F.col(f"hi_{a}")) * 0.5).alias(a) for a in AXES],
        *[F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(least_size)).alias(f"scale_{a}") for a in AXES],
        *[(c / 255.0).alias(n) for n, c in stable_color(F.col("track_id")).items()],
        F.when(F.col("state") == "confirmed", 0.20).otherwise(0.08).alias("alpha"),
        (F.col("hi_z") + 0.12).alias("label_z"),
        F.format_string("#%d [%s] %s n=%d conf=%.2f pts=%d", *[F.col(c) for c in ("track_id", "state", "class_name", "times_seen", "confidence", "point_count")]).alias("text"),
    )
    gone = previous.select(F.col("track_id").alias("id")).distinct().join(records.select(F.col("track_id").alias("id")), "id", "left_anti")
    return boxes.unionByName(gone.withColumn("action", F.lit("delete")), allowMissingColumns=True)


def markers(records: DataFrame, least_size: float = 0.02) -> DataFrame:
    """Box and label of every object; boxes are never thinner than ``least_size``."""
    size = {f"box_{a}": F.greatest(F.col(f"size_{a}"), F.lit(least_size)) for a in AXES}
    return records.withColumns(size).withColumn("text", F.format_string("%s #%d", "label", "track_id"))


def object_map(records: DataFrame, frame: str = "map", source: str = "batch", generated_at: str | None = None) -> DataFrame:
    """The object map document as one JSON row: header and the list of objects by track id."""
    fields = [c for c in records.columns if c != "track_id"]
    objects = F.sort_array(F.collect_list(F.struct("track_id", *fields)))
    at = F.lit(generated_at) if generated_at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), "UTC"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    found = records.agg(objects.alias("objects"), F.count("*").alias("count"))
    return found.select(
        F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(frame).alias("frame_id"), "count", F.lit(source).alias("source"), at.alias("generated_at"), "objects")).alias("value")
    )
