"""Binary clouds: decoding point messages, writing PLY files and object maps."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from voxelar.functions.geometry import AXES, is_finite

# Field sizes of point messages and the projected cloud's layout.
FIELDS = {"x": "f4", "y": "f4", "z": "f4", "rgb": "u4", "class_id": "i4", "detection_id": "u4", "confidence": "f4", "image_u": "f4", "image_v": "f4"}
NEEDED = ("x", "y", "z", "detection_id")


def decode_clouds(messages: DataFrame, layout: dict[str, int], step: int, big_endian: bool = False) -> DataFrame:
    """Points of messages ``(stamp_ns, data)``; ``layout`` gives each field's offset in a point of ``step`` bytes."""
    if lost := [f for f in NEEDED if f not in layout]:
        raise ValueError(f"cloud lacks {lost}")
    names = [f for f in FIELDS if f in layout]
    kind = np.dtype({"names": names, "formats": [(">" if big_endian else "<") + FIELDS[f] for f in names], "offsets": [layout[f] for f in names], "itemsize": step})
    types = {"f": "float", "u": "long", "i": "int"}
    schema = "stamp_ns long, ord long, " + ", ".join(f"{f} {types[FIELDS[f][0]]}" for f in names)

    def run(frames):
        for frame in frames:
            for stamp, data in zip(frame["stamp_ns"], frame["data"], strict=True):
                points = np.frombuffer(data, kind, len(data) // step)
                out = {f: points[f].astype({"f": np.float32, "u": np.int64, "i": np.int32}[FIELDS[f][0]]) for f in names}
                yield pd.DataFrame({"stamp_ns": stamp, "ord": np.arange(len(points)), **out})

    return messages.select("stamp_ns", "data").mapInPandas(run, schema)


def ply_bytes(points: np.ndarray, colors: np.ndarray | None = None) -> bytes:
    """A binary little-endian PLY of float vertices and, if given, byte colours."""
    kind = [("x", "<f4"), ("y", "<f4"), ("z", "<f4")] + ([(c, "u1") for c in ("red", "green", "blue")] if colors is not None else [])
    rows = np.empty(len(points), kind)
    for i, axis in enumerate(("x", "y", "z")):
        rows[axis] = points[:, i]
    for i, (name, _) in enumerate(kind[3:]):
        rows[name] = colors[:, i]
    names = {"<f4": "float", "u1": "uchar"}
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(points)}", *[f"property {names[t]} {n}" for n, t in kind], "end_header"]
    return ("\n".join(head) + "\n").encode() + rows.tobytes()


class PlySource(DataSource):
    """``df.write.format("ply").save(folder)``: one file per track of ``(track_id, points, colors)`` rows."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PlyWriter(self.options["path"])


class _PlyWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        import uuid

        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path)
        fs.create_dir(root, recursive=True)
        for row in rows:
            points = np.array([tuple(p)[:3] for p in row["points"]], np.float32).reshape(-1, 3)
            colors = row["colors"] if "colors" in row.__fields__ else None
            colors = None if colors is None else np.array([tuple(c) for c in colors], np.uint8).reshape(-1, 3)
            temporary = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as out:
                out.write(ply_bytes(points, colors))
            fs.move(temporary, f"{root}/object_{int(row['track_id']):06d}.ply")
        return WriterCommitMessage()


def read_ply(data: bytes) -> np.ndarray:
    """Vertices of a file that ``ply_bytes`` wrote."""
    head, _, body = data.partition(b"end_header\n")
    n = int(head.split(b"element vertex ")[1].split()[0])
    width = 12 + 3 * (b"uchar red" in head)
    return np.array([struct.unpack_from("<fff", body, i * width) for i in range(n)], np.float32).reshape(-1, 3)


def write_object_map(document: DataFrame, path: str) -> None:
    """The document of ``object_map`` as a text file; Spark's commit makes it appear whole or not at all."""
    document.select("value").write.mode("overwrite").text(path)


def write_associations(associations: DataFrame, path: str) -> None:
    """Associations as JSON lines, a folder per session, by frame and observation within a file."""
    ordered = associations.repartition("session").sortWithinPartitions("session", "frame", "observation")
    ordered.write.mode("overwrite").partitionBy("session").json(path)


def write_objects(points: DataFrame, path: str, track: str = "track_id") -> None:
    """One partition of Parquet per object."""
    points.repartition(track).write.mode("overwrite").partitionBy(track).parquet(path)


def saved_objects(spark: SparkSession, path: str, limit: int = 0, least: int = 1, classes: tuple[str, ...] = ()) -> DataFrame:
    """Objects that ``write_objects`` stored with their columns, as a viewer lists them.

    Points that are not finite go, and objects without any other. ``limit`` keeps the most
    observed (0: all); ties by track id.
    """
    points = spark.read.parquet(path).where(F.col("observations") >= least)
    if classes:
        points = points.where(F.col("class_name").isin(list(classes)))
    fine = points.where(is_finite(*[F.col(a) for a in AXES]))
    rest = [c for c in fine.columns if c not in (*AXES, "r", "g", "b")]
    found = fine.groupBy(*rest).agg(F.count("*").alias("point_count"), *[f(a).alias(f"{p}_{a}") for a in AXES for p, f in (("lo", F.min), ("hi", F.max))])
    ordered = found.orderBy(F.desc("observations"), "track_id")
    return ordered.limit(limit) if limit > 0 else ordered


def delete_list(existing: DataFrame, expected: DataFrame, key: str = "file") -> DataFrame:
    """Files of earlier snapshots that no object needs any more."""
    return existing.join(expected, key, "left_anti").select(F.col(key))
