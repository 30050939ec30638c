"""Object snapshots as transactions: a PLY and an NPZ for each object, records beside them, one manifest that names them.

``df.write.format("object_snapshot").mode("append").save(folder)`` for a table, the same with ``writeStream`` for a stream of
snapshots. Files of a snapshot go to a folder of their own, which no reader knows before
the manifest with the next number appears by a rename. Only then older snapshots go.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from .clouds import ply_bytes

FOLDER, MANIFEST = "objects", "manifest-"


@dataclass
class Written(WriterCommitMessage):
    version: str
    part: str
    count: int


def file_system(path: str):
    """The store of a path or URI, and the path in it."""
    import pyarrow.fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _put(fs, path: str, data: bytes) -> None:
    """A whole file or none."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, path)


def object_arrays(row: Row, record: dict) -> tuple[np.ndarray, np.ndarray | None, bytes]:
    """Points and colours of an object, and the bytes of its NPZ."""
    points = np.array([tuple(p)[:3] for p in row["points"]], np.float32).reshape(-1, 3)
    colors = row["colors"] if "colors" in row.__fields__ else None
    colors = None if colors is None else np.array([tuple(c)[:3] for c in colors], np.uint8).reshape(-1, 3)
    arrays = {
        "points_map": points,
        "track_id": np.asarray(record["track_id"], np.int32),
        "class_id": np.asarray(record.get("class_id", -1), np.int32),
        "class_name": np.asarray(record.get("class_name", "")),
        "confidence": np.asarray(record.get("confidence", 0.0), np.float32),
        "observation_count": np.asarray(record.get("times_seen", 0), np.int32),
        "first_seen": np.asarray(record.get("first_seen", 0.0), np.float64),
        "last_seen": np.asarray(record.get("last_seen", 0.0), np.float64),
        "status": np.asarray(record.get("state", "")),
        "missed_frames": np.asarray(record.get("missed_frames", 0), np.int32),
        "semantic_scores": np.asarray(json.dumps(record.get("semantic_scores", {}), sort_keys=True)),
    } | ({} if colors is None else {"rgb": colors})
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return points, colors, out.getvalue()


class _Snapshot:
    """What a task writes, and what commit and abort do with it."""

    def __init__(self, path: str) -> None:
        self.path, self.version = path, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = file_system(self.path)
        batch = TaskContext.get().getLocalProperty("streaming.sql.batchId")  # a stream's batches share a writer
        version = self.version if batch is None else f"{self.version}-{batch}"
        folder = f"{root}/{FOLDER}/{version}"
        fs.create_dir(folder, recursive=True)
        lines = []
        for row in rows:
            record = json.loads(row["record"])
            points, colors, npz = object_arrays(row, record)
            for kind, data in (("ply", ply_bytes(points, colors)), ("npz", npz)):
                name = record[f"point_cloud_{kind}"].rpartition("/")[2]
                _put(fs, f"{folder}/{name}", data)
                record[f"point_cloud_{kind}"] = f"{FOLDER}/{version}/{name}"
            lines.append(json.dumps(record, ensure_ascii=False))
        part = f"{FOLDER}/{version}/records-{uuid.uuid4().hex}.jsonl"
        _put(fs, f"{root}/{part}", "".join(f"{x}\n" for x in lines).encode())
        return Written(version, part, len(lines))

    def finish(self, messages: list[Written | None]) -> None:
        """The snapshot is there from the rename of its manifest on; older ones and what failed attempts left go after it."""
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        version = done[0].version if done else self.version
        number, old = _latest(fs, root)
        manifest = {"schema_version": 1, "version": version, "count": sum(m.count for m in done), "parts": sorted(m.part for m in done)}
        _put(fs, f"{root}/{MANIFEST}{number + 1:09d}.json", json.dumps(manifest).encode())
        self.clean()
        for path in old:
            fs.delete_file(path)

    def clean(self) -> None:
        """Remove all files but those of the current snapshot. A folder has one writer at a time."""
        fs, root = file_system(self.path)
        manifest = current_manifest(self.path)
        for path in _listed(fs, f"{root}/{FOLDER}"):
            if manifest is None or path.rpartition("/")[2] != manifest["version"]:
                fs.delete_dir(path)


def _listed(fs, folder: str) -> list[str]:
    import pyarrow.fs

    return [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))]


def _latest(fs, root: str) -> tuple[int, list[str]]:
    """The highest number of a manifest (0: none), and all manifests."""
    found = sorted(f for f in _listed(fs, root) if f.rpartition("/")[2].startswith(MANIFEST) and f.endswith(".json"))
    return (int(found[-1][-14:-5]) if found else 0), found


class _TableWriter(_Snapshot, DataSourceWriter):
    def commit(self, messages) -> None:
        self.finish(messages)

    def abort(self, messages) -> None:
        self.clean()


class _StreamWriter(_Snapshot, DataSourceStreamWriter):
    """Every batch is a snapshot of its own, which replaces that of the batch before."""

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        self.finish(messages)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self.clean()


class ObjectSnapshot(DataSource):
    """Rows ``record`` (JSON as from ``full_records``), ``points`` and, if known, ``colors`` (arrays of structs)."""

    @classmethod
    def name(cls) -> str:
        return "object_snapshot"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TableWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _StreamWriter(self.options["path"])


def write_snapshot(objects: DataFrame, path: str) -> None:
    """Replace the snapshot in a folder; readers see the one before until the new one is whole."""
    objects.sparkSession.dataSource.register(ObjectSnapshot)
    objects.write.format("object_snapshot").mode("append").save(path)


def current_manifest(path: str) -> dict | None:
    fs, root = file_system(path)
    _, found = _latest(fs, root)
    if not found:
        return None
    with fs.open_input_stream(found[-1]) as f:
        return json.loads(f.read())


def read_snapshot(spark: SparkSession, path: str, schema: str = "track_id long, class_name string, point_count long, point_cloud_ply string, point_cloud_npz string") -> DataFrame:
    """Records of the current snapshot; none where there is no snapshot."""
    manifest = current_manifest(path)
    parts = [f"{path.rstrip('/')}/{p}" for p in manifest["parts"]] if manifest else []
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)


def snapshot_files(spark: SparkSession, path: str, kind: str = "ply") -> DataFrame:
    """``file`` (as records name it), ``content`` of the files of the current snapshot."""
    manifest = current_manifest(path)
    folder = f"{path.rstrip('/')}/{FOLDER}/{manifest['version'] if manifest else '-'}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(folder)  # each file a row, read by tasks
    return found.select(F.regexp_extract("path", f"({FOLDER}/[^/]+/[^/]+)$", 1).alias("file"), "content")
