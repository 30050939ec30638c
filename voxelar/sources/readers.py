"""Readers of detection logs, trajectories, cameras, vocabularies and frame manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelar.functions.detection import accepted_offline, stamp_ns, with_defaults

DETECTIONS = "array<struct<class_id:int,class_name:string,confidence:double,xyxy:array<double>>>"
PAYLOAD = f"stamp_sec long, stamp_nanosec long, image_shape array<int>, detections {DETECTIONS}"
MAX_CLASSES = 80
EMBEDDING = 512


def parsed_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Payloads of a detection log of text lines, by stamp; blank and broken lines and rows without stamp go."""
    rows = lines.select(F.monotonically_increasing_id().alias("ord"), F.from_json(value, PAYLOAD).alias("p"))
    found = rows.select("ord", "p.*").withColumn("stamp_ns", stamp_ns(F.col("stamp_sec"), F.col("stamp_nanosec")))
    return found.where("stamp_ns is not null")


def detection_log(spark: SparkSession, path: str) -> DataFrame:
    return parsed_log(spark.read.text(path)).orderBy("stamp_ns", "ord")


def detections(payloads: DataFrame, least: float = 0.0) -> DataFrame:
    """One row per accepted detection, numbered after the filter."""
    flat = payloads.select(*[c for c in payloads.columns if c != "detections"], F.posexplode("detections").alias("raw_id", "d"))
    named = flat.select(*[c for c in flat.columns if c != "d"], *with_defaults())
    kept = named.where(accepted_offline(F.col("class_name"), F.col("confidence"), F.col("xyxy"), least))
    key = [c for c in ("frame_id", "stamp_ns", "ord") if c in kept.columns]
    return kept.withColumn("detection_id", F.row_number().over(W.partitionBy(*key).orderBy("raw_id")) - 1)


def detection_files(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """Accepted detections of a folder of JSON files, one per frame; the digits of a file's name are its frame id."""
    raw = spark.read.option("multiLine", True).schema(f"detections {DETECTIONS}").json(path)
    frame = F.regexp_extract(F.input_file_name(), r"(\d+)[^/\d]*\.json$", 1).try_cast("long").alias("frame_id")
    return detections(raw.select(frame, F.coalesce("detections", F.array().cast(DETECTIONS)).alias("detections")), least)


def with_poses(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Frames with the pose of their index; a frame beyond the trajectory has none and goes."""
    return frames.join(poses, "frame_id")


def depth_metres(depth: Column, scale: Column | float, multiply: bool = False) -> Column:
    """Raw depth in metres: divided by a file's scale, or times a live stream's factor."""
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    return depth.cast("double") * factor if multiply else F.try_divide(depth.cast("double"), factor)


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Poses ``(frame_id, pose)``, sixteen numbers each, from lines of row-major text."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s*\n\s*")).alias("frame_id", "line"))
    numbers = F.transform(F.split("line", r"\s+"), lambda x: x.try_cast("double"))
    return lines.select(F.col("frame_id").cast("long").alias("frame_id"), numbers.alias("pose")).where(F.size("pose") == 16)


def camera(spark: SparkSession, path: str) -> DataFrame:
    """Intrinsics from JSON; the depth scale defaults to 1000."""
    schema = "camera struct<fx:double,fy:double,cx:double,cy:double,scale:double>, fx double, fy double, cx double, cy double, scale double"
    found = spark.read.schema(schema).json(path, multiLine=True)
    values = {c: F.coalesce(f"camera.{c}", c) for c in ("fx", "fy", "cx", "cy", "scale")}
    return found.select(*[(F.coalesce(v, F.lit(1000.0)) if c == "scale" else v).alias(c) for c, v in values.items()])


def vocabulary(lines: DataFrame, most: int = MAX_CLASSES, value: str = "value") -> DataFrame:
    """``(class_id, class_name)`` from a class list; reading an empty or too long one is an error."""
    named = lines.select(F.monotonically_increasing_id().alias("o"), F.trim(value).alias("class_name"))
    named = named.where("class_name <> '' and not startswith(class_name, '#')")
    listed = named.agg(F.sort_array(F.collect_list(F.struct("o", "class_name"))).alias("names"))
    n = F.size("names")
    checked = listed.select(
        F.when(n == 0, F.raise_error("class list is empty")).when(n > most, F.raise_error(f"at most {most} classes")).otherwise(F.col("names")).alias("names")
    )
    return checked.select(F.posexplode("names").alias("class_id", "c")).select("class_id", F.col("c.class_name").alias("class_name"))


def padded_embeddings(rows: DataFrame, slots: int = MAX_CLASSES, width: int = EMBEDDING) -> DataFrame:
    """``(slot, embedding)`` for every prompt slot, zeros where there is none; other widths are an error."""
    checked = rows.where(F.col("slot") < slots).select(
        "slot", F.when(F.size("embedding") == width, F.col("embedding")).otherwise(F.raise_error(f"embeddings need {width} numbers")).alias("embedding")
    )
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(checked, "slot", "left").select("slot", F.coalesce("embedding", zeros).alias("embedding"))


def manifest(files: DataFrame, poses: int, start: int = 0, step: int = 1, limit: int | None = None) -> DataFrame:
    """Frame ids that can be processed: start, start + step, ... below ``poses``, up to the first missing file.

    ``files``: ``frame_id, kind`` with kinds ``rgb`` and ``depth``.
    """
    if step < 1:
        raise ValueError("frame step must be at least 1")
    spark = files.sparkSession
    wanted = spark.range(start, poses, step).withColumnRenamed("id", "frame_id")
    both = files.groupBy("frame_id").agg(F.count_distinct("kind").alias("k")).where("k = 2").select("frame_id")
    missing = wanted.join(both, "frame_id", "left_anti").agg(F.min("frame_id").alias("stop"))
    found = wanted.crossJoin(F.broadcast(missing)).where("stop is null or frame_id < stop").select("frame_id")
    return found.orderBy("frame_id").limit(limit) if limit is not None else found


def use_exported(frames: DataFrame, files: DataFrame) -> bool:
    """Whether every frame has an exported detection file; one missing file means the detector runs for all."""
    return frames.join(files.select("frame_id"), "frame_id", "left_anti").isEmpty()
