"""Column expressions for detections, stamps, names and classes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Always excluded when detections are read from files (a fixed value).
PERSON = "person"


def with_defaults() -> list[Column]:
    """Detection fields of a struct ``d``, missing ones with their defaults."""
    return [
        F.coalesce(F.col("d.class_id"), F.lit(-1)).cast("int").alias("class_id"),
        F.coalesce(F.col("d.class_name"), F.lit("unknown")).alias("class_name"),
        F.coalesce(F.col("d.confidence"), F.lit(0.0)).alias("confidence"),
        F.col("d.xyxy").alias("xyxy"),
    ]


def accepted_offline(name: Column, confidence: Column, xyxy: Column | None, least: float) -> Column:
    """File detections: confident enough, no person, four corners."""
    ok = (F.coalesce(confidence, F.lit(0.0)) >= least) & (F.lower(F.coalesce(name, F.lit("unknown"))) != PERSON)
    return ok if xyxy is None else ok & (F.coalesce(F.size(xyxy), F.lit(0)) == 4)


def excluded_online(
    name: Column, class_id: Column, confidence: Column, least: float, labels: Iterable[str] = (), ids: Iterable[int] = ()
) -> Column:
    """Live detections: too uncertain, or a label (trimmed, any case) or class id that is excluded."""
    out = F.coalesce(confidence, F.lit(0.0)) < least
    if labels := sorted({x.strip().casefold() for x in labels}):
        out = out | F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(labels)
    if ids := sorted(set(ids)):
        out = out | F.coalesce(class_id, F.lit(-1)).isin(ids)
    return out


def image_size(shape: Column, fallback: tuple[int, int]) -> Column:
    """Width and height from a payload's ``[height, width, ...]`` if both are positive."""
    h, w = F.get(shape, 0).try_cast("int"), F.get(shape, 1).try_cast("int")
    fine = (h > 0) & (w > 0)
    return F.when(fine, F.struct(w.alias("width"), h.alias("height"))).otherwise(
        F.struct(F.lit(fallback[0]).alias("width"), F.lit(fallback[1]).alias("height"))
    )


def stamp_ns(sec: Column, nanosec: Column) -> Column:
    """An exact stamp in nanoseconds; null if a part is missing."""
    return sec.cast("long") * 1_000_000_000 + nanosec.cast("long")


def stamp_seconds(ns: Column) -> Column:
    return ns.cast("double") / 1e9


def safe_name(name: Column, key: bool = False) -> Column:
    """Letters, digits, ``-`` and ``_`` of a name; as a ``key`` lower case without outer underscores."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    if not key:
        return clean
    trimmed = F.trim(F.lower(clean), F.lit("_"))
    return F.when(trimmed == "", F.lit("unknown")).otherwise(trimmed)


def named_classes(rows: DataFrame, vocabulary: DataFrame, class_col: str = "class_id", fallback: bool = False) -> DataFrame:
    """Rows with the ``class_name`` of their class; classes outside the vocabulary go, or are named by their id.

    A vocabulary is bounded (80 prompts), so it is broadcast.
    """
    known = F.broadcast(vocabulary.select(F.col("class_id").alias(class_col), "class_name"))
    if not fallback:
        return rows.join(known, class_col)
    named = rows.join(known, class_col, "left")
    return named.withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col(class_col).cast("string"))))


def associated(detections: DataFrame, associations: DataFrame) -> DataFrame:
    """Frame records with what their association says; records that none took keep nulls.

    Both by ``session, frame, observation``, the place of a record in its frame.
    """
    found = associations.select(
        "session", "frame", "observation", "track_id", F.col("score").alias("association_score"),
        F.col("overlap").alias("geometric_overlap"), F.col("similarity").alias("semantic_similarity"), F.col("is_new").alias("is_new_track"),
    )
    return detections.join(found, ["session", "frame", "observation"], "left")


def status(count: Column, least: int) -> Column:
    return F.when(count >= max(1, least), F.lit("confirmed")).otherwise(F.lit("candidate"))


def similarity(class_id: Column, name: Column, track_class: Column, track_name: Column, scores: Column) -> Column:
    """How well a detection's class fits a track's history of class scores (map of class to score)."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x)
    share = F.coalesce(F.try_element_at(scores, class_id), F.lit(0.0)) / total
    return (
        F.when(class_id < 0, (name == track_name).cast("double"))
        .when(F.coalesce(total, F.lit(0.0)) <= 0, (class_id == track_class).cast("double"))
        .otherwise(share)
    )
