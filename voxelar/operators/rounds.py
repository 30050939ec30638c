"""Object tracks by rounds: the n-th frames of all sessions are taken in together, by joins and aggregations.

A round meets its observations with the live tracks by their boxes, measures overlaps on
neighbour cells, scores, assigns one to one and folds the new points into the tracks' voxels.
Tracks and their points are tables between rounds, so no task ever holds a session; only the
scored pairs of one frame, a handful, meet in one group.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelar.config import MapConfig
from voxelar.functions.detection import similarity, status
from voxelar.functions.geometry import AXES, growth_valid
from voxelar.plans.components import connected_components
from voxelar.plans.cut import dealt, materialize

from .boxes import assignment
from .cleaning import LEAST_POINTS
from .spatial import WIDE, cloud_bounds, even_subsample, facing_boxes, largest_cluster, radius_hits
from .voxels import CELLS, fold_clouds, voxel_mean, with_cells

DETAILS = ("score", "overlap", "similarity", "box_overlap")
_PLACE = ("session", "frame", "observation")
_TRACK = ("session", "track", "class_id", "class_name", "confidence", "first", "last", "count", "missed", "scores", "names")
_POINT = ("session", "track", *AXES)


@dataclasses.dataclass(frozen=True)
class Live:
    """Live tracks and their points (``_TRACK``, ``_POINT``); ``None`` before the first round.

    A track is named by the place of its first observation, which ascends with its age.
    """

    tracks: DataFrame | None = None
    points: DataFrame | None = None


def track_rounds(observations: DataFrame, config: MapConfig = MapConfig()) -> DataFrame:
    """Associations of all sessions, as ``streaming.tracker.track_batch`` gives them.

    ``observations``: ``session, frame, observation, class_id, class_name, confidence, stamp,
    points`` and, if geometry may be replaced instead of fused, ``fuse``; cleaned, so points stand
    in the order of their voxels. Assignments of equal sums may fall out differently. A round takes
    some jobs, so many sessions cost as much time as the longest: few long ones are for
    ``track_batch``. Observations of fewer than three points age tracks but get no row.
    """
    spark = observations.sparkSession
    numbered = observations.select("session", "frame").distinct()
    numbered = numbered.withColumn("step", F.row_number().over(W.partitionBy("session").orderBy("frame")))
    fuse = F.coalesce("fuse", F.lit(True)) if "fuse" in observations.columns else F.lit(True)
    # A frame has fewer than 2^32 observations.
    place = F.shiftleft(F.col("step").cast("long"), 32) + F.row_number().over(W.partitionBy("session", "frame").orderBy("observation"))
    told = observations.join(numbered, ["session", "frame"]).select(
        *_PLACE, "step", place.alias("place"), "class_id", "class_name", F.col("confidence").cast("double"), F.col("stamp").cast("double"), fuse.alias("fuse"), "points"
    )
    # In order of the rounds, so that each reads its own row groups.
    told = materialize(told.repartitionByRange("step", "session").sortWithinPartitions("step"), "told")
    live, rows = Live(), []
    for step in range(1, (told.agg(F.max("step")).first()[0] or 0) + 1):
        found, live = advance(live, told.where(F.col("step") == step), step, config)
        rows.append(found)
    if not rows:
        none = told.select(*_PLACE, F.lit(0).cast("long").alias("track_id"), *[F.lit(1.0).alias(d) for d in DETAILS], F.lit(True).alias("is_new"))
        return none.where("false")
    every = spark.read.schema(rows[0].schema).parquet(*[f for r in rows for f in r.inputFiles()])
    born = every.where("is_new").select("session", F.col("place").alias("track"))
    named = born.withColumn("track_id", F.row_number().over(W.partitionBy("session").orderBy("track")).cast("long"))
    return every.join(named, ["session", "track"]).select(*_PLACE, "track_id", *DETAILS, "is_new")


def advance(live: Live, told: DataFrame, step: int, config: MapConfig) -> tuple[DataFrame, Live]:
    """One round: rows of the frames in ``told``, and the tracks after it; sessions without a frame are over."""
    frames = told.groupBy("session").agg(F.max("stamp").alias("now"))
    seen = told.where(F.size("points") >= LEAST_POINTS)
    clouds = seen.select("session", "place", F.posexplode("points").alias("ord", "p")).select("session", "place", "ord", *[F.col(f"p.{a}").cast("float").alias(a) for a in AXES])
    about = seen.drop("points", "step")
    if live.tracks is None:
        alone = [F.lit(1.0).alias(d) for d in DETAILS]
        rows = materialize(about.select("*", F.col("place").alias("track"), *alone, F.lit(True).alias("is_new")), "rows")
        tracks, points = _opened(rows), _own(clouds, rows).select(*_POINT)
    else:
        held = Live(live.tracks.join(frames.select("session"), "session", "left_semi"), live.points.join(frames.select("session"), "session", "left_semi"))
        rows = materialize(_matched(held, about, clouds, config), "rows")
        tracks, points = _taken_in(held, rows, config).unionByName(_opened(rows)), _fused(held, rows, clouds, config)
    tracks = materialize(_unexpired(tracks, frames, config), "tracks")
    now = Live(tracks, materialize(points.join(tracks.select("session", "track"), ["session", "track"], "left_semi"), "points"))
    if config.merge_interval and step % config.merge_interval == 0:
        now, moved = _merged(now, config)
        if moved is not None:
            renamed = rows.join(moved, ["session", "track"], "left").withColumn("track", F.coalesce("root", "track"))
            rows = materialize(renamed.select(*rows.columns), "rows")
    if config.denoise_interval and step % config.denoise_interval == 0:
        now = Live(now.tracks, _denoised(now.points, config))
    return rows, now


def cloud_shares(pairs: DataFrame, left: DataFrame, right: DataFrame, radius: float, key: Sequence[str]) -> DataFrame:
    """``pairs`` of clouds with ``overlap``, the larger share of either's points that has a point of the other within ``radius``.

    ``left``, ``right``: points with the columns of ``key`` that name their clouds; a share is
    counted over the points given. The points of a pair meet in one task, so that their copies are not
    shuffled, where the result is cut by ``materialize(..., together=True)``.
    """
    out, clouds = pairs, (left, right)
    sides = [dealt(pairs.select(*key).join(p, _shared(key, p)), key) for p in clouds]
    for n, (a, b) in enumerate((sides, sides[::-1])):
        hits = radius_hits(a, b, radius, key, WIDE).groupBy(*key).agg(F.count("*").alias(f"hits{n}"))
        names = _shared(key, clouds[n])
        sizes = clouds[n].groupBy(*names).agg(F.count("*").alias(f"n{n}"))
        out = out.join(hits, list(key), "left").join(sizes, names, "left")
    share = [F.coalesce(F.col(f"hits{n}") / F.col(f"n{n}"), F.lit(0.0)) for n in (0, 1)]
    return out.withColumn("overlap", F.greatest(*share)).drop("n0", "n1", "hits0", "hits1")


def _shared(key: Sequence[str], points: DataFrame) -> list[str]:
    return [k for k in key if k in points.columns]


def _searched(points: DataFrame, by: Sequence[str], order: str, config: MapConfig) -> DataFrame:
    """The points that an association looks at."""
    some = even_subsample(points, config.association_max_points, order, by) if config.association_max_points > 0 else points
    return some.select(*by, *AXES)


def _in_cells(points: DataFrame, config: MapConfig) -> DataFrame:
    """Points of tracks with their order, that of their voxels."""
    celled = with_cells(points, config.voxel_size, narrow=True)
    return celled.select(*_POINT, F.struct(*CELLS, *AXES).alias("ord"))


def _matched(live: Live, about: DataFrame, clouds: DataFrame, config: MapConfig) -> DataFrame:
    """Each observation with the track it goes to, its own place where it opens one."""
    new, old = cloud_bounds(clouds, ["session", "place"]), cloud_bounds(live.points, ["session", "track"])
    facing = facing_boxes(new, old, config.overlap_radius, config.max_centroid_distance, ["session"])
    fits = growth_valid("b_", "a_", config.voxel_size, config.max_extent_growth, config.overlap_radius)
    near = facing.where(fits & (F.col("box_overlap") >= config.min_box_overlap))
    near = materialize(near.select("session", F.col("a_place").alias("place"), F.col("b_track").alias("track"), "box_overlap"), "near")
    looked = _searched(clouds, ["session", "place"], "ord", config), _searched(_in_cells(live.points, config), ["session", "track"], "ord", config)
    shares = cloud_shares(near, *looked, config.overlap_radius, ["session", "place", "track"]).where(F.col("overlap") >= config.min_geometric_overlap)
    told = about.select("session", "place", "class_id", "class_name")
    known = live.tracks.select("session", "track", F.col("class_id").alias("t_class"), F.col("class_name").alias("t_name"), "scores")
    weight = config.geometry_weight / (config.geometry_weight + config.semantic_weight)
    similar = similarity(F.col("class_id"), F.col("class_name"), F.col("t_class"), F.col("t_name"), F.col("scores"))
    scored = shares.join(told, ["session", "place"]).join(known, ["session", "track"]).withColumn("similarity", similar)
    scored = scored.withColumn("score", weight * F.col("overlap") + (1 - weight) * F.col("similarity")).where(F.col("score") >= config.association_threshold)
    scored = materialize(scored.select("session", "place", "track", *DETAILS), "scored", together=True)
    chosen = assignment(scored, "session", "place", "track", "score").drop("score")
    best = scored.join(chosen, ["session", "place", "track"])
    is_new = F.col("track").isNull().alias("is_new")
    rest = [c for c in about.columns if c not in ("session", "place")]
    return about.join(best, ["session", "place"], "left").select(
        *_PLACE, "place", *[c for c in rest if c not in _PLACE], F.coalesce("track", "place").alias("track"), *[F.coalesce(d, F.lit(1.0)).alias(d) for d in DETAILS], is_new
    )


def _own(clouds: DataFrame, rows: DataFrame) -> DataFrame:
    """Points of observations under the track they went to."""
    return clouds.join(rows.select("session", "place", "track", "fuse", "is_new"), ["session", "place"])


def _weight() -> Column:
    return F.greatest(F.lit(0.0), F.col("confidence"))


def _opened(rows: DataFrame) -> DataFrame:
    first = {"first": F.col("stamp"), "last": F.col("stamp"), "count": F.lit(1).cast("long"), "missed": F.lit(0).cast("long")}
    maps = {"scores": F.create_map("class_id", _weight()), "names": F.create_map("class_id", "class_name")}
    return rows.where("is_new").withColumns(first | maps).select(*_TRACK)


def _added(scores: Column, more: Column) -> Column:
    """Evidence summed by class, classes in the order of their first evidence."""
    known = F.transform_values(scores, lambda k, v: v + F.coalesce(F.try_element_at(more, k), F.lit(0.0)))
    return F.map_concat(known, F.map_filter(more, lambda k, v: ~F.map_contains_key(scores, k)))


def _renamed(names: Column, more: Column) -> Column:
    return F.map_zip_with(names, more, lambda k, a, b: F.coalesce(b, a))


def _with_class(tracks: DataFrame) -> DataFrame:
    """The class with most evidence; of equal ones the first."""
    entries = F.map_entries("scores")
    best = F.aggregate(entries, F.get(entries, 0), lambda m, e: F.when(e["value"] > m["value"], e).otherwise(m))
    tracks = tracks.withColumn("class_id", best["key"])
    return tracks.withColumn("class_name", F.coalesce(F.try_element_at("names", "class_id"), "class_name")).select(*_TRACK)


def _taken_in(live: Live, rows: DataFrame, config: MapConfig) -> DataFrame:
    """Tracks one frame older, with what they took of it."""
    took = rows.where("not is_new").select(
        "session", "track", F.col("confidence").alias("o_confidence"), F.col("stamp"), F.create_map("class_id", _weight()).alias("o_scores"), F.create_map("class_id", "class_name").alias("o_names")
    )
    hit = F.col("stamp").isNotNull()
    both = live.tracks.join(took, ["session", "track"], "left")
    values = {
        "confidence": F.when(hit, (F.col("confidence") * F.col("count") + F.col("o_confidence")) / (F.col("count") + 1)).otherwise(F.col("confidence")),
        "last": F.when(hit, F.greatest("last", "stamp")).otherwise(F.col("last")),
        "count": F.col("count") + hit.cast("long"),
        "missed": F.when(hit, F.lit(0).cast("long")).otherwise(F.col("missed") + 1),
        "scores": F.when(hit, _added(F.col("scores"), F.col("o_scores"))).otherwise(F.col("scores")),
        "names": F.when(hit, _renamed(F.col("names"), F.col("o_names"))).otherwise(F.col("names")),
    }
    return _with_class(both.withColumns(values))


def _fused(live: Live, rows: DataFrame, clouds: DataFrame, config: MapConfig) -> DataFrame:
    """Points of all tracks: midpoints where voxels are shared, an observation's own where it opens or replaces a track."""
    own = _own(clouds, rows)
    took = rows.where("not is_new").select("session", "track", "fuse")
    kept = live.points.join(took.where("fuse").select("session", "track"), ["session", "track"], "left_semi")
    both = kept.select(*_POINT).unionByName(own.where("fuse and not is_new").select(*_POINT))
    mixed = voxel_mean(both, config.voxel_size, ["session", "track"], narrow=True).select("session", "track", *[F.col(a).cast("float").alias(a) for a in AXES])
    untouched = live.points.join(took.select("session", "track"), ["session", "track"], "left_anti").select(*_POINT)
    return mixed.unionByName(untouched).unionByName(own.where("is_new or not fuse").select(*_POINT))


def _unexpired(tracks: DataFrame, frames: DataFrame, config: MapConfig) -> DataFrame:
    """Without candidates missed too often and, if tracks age, without those last seen too long ago."""
    lost = (status(F.col("count"), config.min_confirmed) == "candidate") & (F.col("missed") > config.max_missed)
    old = F.lit(config.stale_after > 0) & (F.col("now") > 0) & (F.col("now") - F.col("last") > config.stale_after)
    return tracks.join(frames, "session").where(~(lost | F.coalesce(old, F.lit(False)))).select(*_TRACK)


def _merged(live: Live, config: MapConfig) -> tuple[Live, DataFrame | None]:
    """Tracks of one class that overlap as one, under the oldest; and where the others went."""
    bounds = cloud_bounds(live.points, ["session", "track"]).join(live.tracks.select("session", "track", "class_id"), ["session", "track"])
    facing = facing_boxes(bounds, bounds, config.overlap_radius, config.max_centroid_distance, ["session", "class_id"]).where("a_track < b_track")
    near = materialize(facing.select("session", F.col("a_track").alias("a"), F.col("b_track").alias("b")), "near")
    looked = _searched(_in_cells(live.points, config), ["session", "track"], "ord", config)
    shares = cloud_shares(near, looked.withColumnRenamed("track", "a"), looked.withColumnRenamed("track", "b"), config.overlap_radius, ["session", "a", "b"])
    doubles = materialize(shares.where(F.col("overlap") >= config.merge_overlap).select(F.struct("session", "a").alias("a"), F.struct("session", F.col("b").alias("a")).alias("b")), "doubles", together=True)
    if doubles.isEmpty():
        return live, None
    found = connected_components(doubles)
    moved = materialize(found.select("node.session", F.col("node.a").alias("track"), F.col("component.a").alias("root")), "moved")
    one = live.tracks.join(moved, ["session", "track"])
    # The doubles of one object in a session: a few rows.
    parts = F.sort_array(F.collect_list(F.struct("track", "scores_", "names_", "class_id", "class_name")))
    listed = one.withColumns({"scores_": F.map_entries("scores"), "names_": F.map_entries("names")}).groupBy("session", "root").agg(
        (F.sum(F.col("confidence") * F.col("count")) / F.sum("count")).alias("confidence"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("count").alias("count"), F.min("missed").alias("missed"), parts.alias("parts"),
    )
    rest = F.slice("parts", 2, 1 << 30)
    head = F.get("parts", 0)
    joined = listed.select(
        "session", F.col("root").alias("track"), head["class_id"].alias("class_id"), head["class_name"].alias("class_name"), "confidence", "first", "last", "count", "missed",
        F.aggregate(rest, F.map_from_entries(head["scores_"]), lambda m, p: _added(m, F.map_from_entries(p["scores_"]))).alias("scores"),
        F.aggregate(rest, F.map_from_entries(head["names_"]), lambda m, p: _renamed(m, F.map_from_entries(p["names_"]))).alias("names"),
    )
    single = live.tracks.join(moved.select("session", "track"), ["session", "track"], "left_anti")
    tracks = single.select(*_TRACK).unionByName(_with_class(joined))
    mine = live.points.join(moved, ["session", "track"])
    folded = fold_clouds(mine, config.voxel_size, "track", ["session", "root"]).select("session", F.col("root").alias("track"), *[F.col(a).cast("float").alias(a) for a in AXES])
    points = live.points.join(moved.select("session", "track"), ["session", "track"], "left_anti").select(*_POINT).unionByName(folded)
    return Live(materialize(tracks, "tracks"), materialize(points, "points")), moved


def _denoised(points: DataFrame, config: MapConfig) -> DataFrame:
    """The largest cluster of every track."""
    sorted_ = with_cells(points, config.voxel_size, narrow=True).repartition("session", "track").sortWithinPartitions("session", "track", *CELLS)
    numbered = materialize(sorted_.select(*_POINT, F.monotonically_increasing_id().alias("ord")), "numbered")
    kept = largest_cluster(numbered, config.cluster_eps, config.cluster_min_points, "ord", ["session", "track"]).where("kept")
    return materialize(numbered.join(kept.select("ord"), "ord", "left_semi").select(*_POINT), "points")
