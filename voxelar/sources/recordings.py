"""Recorded messages as a stream with offsets, partitions and a limit for each batch.

A recording is a folder of files, read in the order of their names; a file is a run of
messages, each a little-endian stamp (8 bytes), a size (4 bytes) and its bytes. A file beside
it, ``.msg.count``, holds its number of messages, so that the driver need not read messages to number them.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .snapshots import _listed, _put, file_system

HEAD = struct.Struct("<qI")
SCHEMA = "stamp_ns long, data binary"
#: Partitions of a full batch, where ``partition_messages`` does not say how large they are.
PARTITIONS = 64


def write_recording(messages: Sequence[tuple[int, bytes]], path: str, name: str) -> None:
    """One file of a recording; it appears whole."""
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    raw = b"".join(HEAD.pack(stamp, len(data)) + data for stamp, data in messages)
    _put(fs, f"{root}/{name}.msg.count", json.dumps({"messages": len(messages), "bytes": len(raw)}).encode())
    _put(fs, f"{root}/{name}.msg", raw)


def _heads(raw: bytes) -> list[int]:
    """Where the messages of a file begin, and its end; a message that was cut off does not count."""
    at, found = 0, [0]
    while at + HEAD.size <= len(raw) and at + HEAD.size + HEAD.unpack_from(raw, at)[1] <= len(raw):
        at += HEAD.size + HEAD.unpack_from(raw, at)[1]
        found.append(at)
    return found


@dataclass
class Span(InputPartition):
    """Messages ``first`` to ``last`` (excluded) of each of some files."""

    pieces: list[tuple[str, int, int]]


def _count(fs, path: str, counted: bool) -> int:
    """Whole messages of a file: as counted when it was written, unless it has been cut off since."""
    if counted:
        with fs.open_input_stream(f"{path}.count") as f:
            known = json.loads(f.read())
        if known["bytes"] == fs.get_file_info(path).size:
            return known["messages"]
    with fs.open_input_stream(path) as f:
        return len(_heads(f.read())) - 1


class _Reader(DataSourceStreamReader):
    """Offsets are numbers of messages over all files. A batch takes ``max_messages`` at most.

    Which messages a batch was planned for is kept in the file ``progress`` before it runs: a reader that starts anew
    does not know where the last one stood, and without that could only offer everything or go back.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.progress = options["path"], options["progress"]
        self.limit, self.size = int(options.get("max_messages", 1000)), int(options.get("partition_messages", 0))
        self.size = self.size or max(100, -(-self.limit // PARTITIONS))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"message": 0}

    def _files(self) -> list[tuple[str, int, int]]:
        """Files with the number of their first message and how many they hold; new files are counted once."""
        fs, root = file_system(self.path)
        found, first, listed = [], 0, set(_listed(fs, root))
        for path in sorted(p for p in listed if p.endswith(".msg")):
            if path not in self.known:
                self.known[path] = _count(fs, path, f"{path}.count" in listed)
            found.append((path, first, self.known[path]))
            first += self.known[path]
        return found

    def _planned(self) -> int:
        fs, path = file_system(self.progress)
        if not fs.get_file_info(path).is_file:
            return 0
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())["message"]

    def latestOffset(self) -> dict:  # noqa: N802
        there = sum(n for _, _, n in self._files())
        return {"message": min(there, self._planned() + self.limit)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = start["message"], end["message"]
        if last > self._planned():
            fs, path = file_system(self.progress)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            _put(fs, path, json.dumps(end).encode())
        spans, room = [], 0
        for path, base, n in self._files():
            low, high = max(first - base, 0), min(last - base, n)
            while low < high:
                if not room:
                    spans.append(Span([]))
                    room = self.size
                take = min(room, high - low)
                spans[-1].pieces.append((path, low, low + take))
                low, room = low + take, room - take
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for path, first, last in partition.pieces:
            with fs.open_input_stream(path) as f:
                raw = f.read()
            ends = _heads(raw)[: last + 1]
            stamps = [HEAD.unpack_from(raw, at)[0] for at in ends[first:last]]
            data = [raw[at + HEAD.size : end] for at, end in zip(ends[first:last], ends[first + 1 :], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(stamps, pa.int64()), pa.array(data, pa.binary())], ["stamp_ns", "data"])

    def commit(self, end: dict) -> None:
        pass


class Recording(DataSource):
    """``spark.readStream.format("recording")``: ``stamp_ns, data``; options ``path``, ``progress``, ``max_messages``, ``partition_messages``."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(dict(self.options))


def recording_stream(spark: SparkSession, path: str, progress: str, max_messages: int = 1000) -> DataFrame:
    """Messages of a recording as a stream, ``max_messages`` a batch at most."""
    spark.dataSource.register(Recording)
    return spark.readStream.format("recording").option("path", path).option("progress", progress).option("max_messages", max_messages).load()


def record(messages: DataFrame, path: str) -> None:
    """Write ``file`` (string), ``stamp_ns``, ``data`` rows as a recording, by stamp within a file; a file is one task's, so it should be small."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("stamp_ns")
        write_recording(list(zip(table.column("stamp_ns").to_pylist(), table.column("data").to_pylist(), strict=True)), path, table.column("file")[0].as_py())
        return pa.table({"messages": pa.array([table.num_rows], pa.int64())})

    messages.select("file", "stamp_ns", "data").groupBy("file").applyInArrow(run, "messages long").write.format("noop").mode("overwrite").save()
