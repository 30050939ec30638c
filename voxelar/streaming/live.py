"""Live pairing of depth frames and detections in buffers bounded by count, as keyed state of a stream."""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

OUTCOMES = "session string, arrival long, ns long, outcome string, trigger string, detection long, detection_ns long, gap_ns long"
_NAMES = [x.split()[0] for x in OUTCOMES.split(", ")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Buffers:
    """What a session remembers: the last ``size`` detections and depth frames, and the stamps of twice as many handled frames.

    A depth frame is handled once, when a detection within ``reach_ns`` is in the buffer: ``delay`` frames after it came
    or, without a delay, when it comes and again, if that failed, when a later detection has it as its nearest frame.
    """

    size: int
    reach_ns: int
    delay: int = 0
    detections: deque = field(default_factory=deque)
    depths: deque = field(default_factory=deque)
    handled: deque = field(default_factory=deque)

    def detection(self, arrival: int, ns: int) -> list[tuple]:
        self.detections.append((arrival, ns))
        if len(self.detections) > self.size:
            self.detections.popleft()
        if self.delay or not self.depths:
            return []
        near = min(self.depths, key=lambda d: abs(d[1] - ns))  # of equally near ones the first that came
        return self._handle(near, "detection") if abs(near[1] - ns) <= self.reach_ns else []

    def depth(self, arrival: int, ns: int) -> list[tuple]:
        out = []
        self.depths.append((arrival, ns))
        if len(self.depths) > self.size:
            old = self.depths.popleft()
            if old[1] not in self.handled:
                out.append((*old, "evicted", "depth", None, None, None))
        if len(self.depths) > self.delay:
            out += self._handle(self.depths[-1 - self.delay], "depth")
        return out

    def _handle(self, frame: tuple[int, int], trigger: str) -> list[tuple]:
        if frame[1] in self.handled:
            return [(*frame, "repeated", trigger, None, None, None)] if trigger == "depth" else []
        if not self.detections:
            return []
        arrival, ns = min(self.detections, key=lambda d: abs(d[1] - frame[1]))
        gap = abs(ns - frame[1])
        if gap > self.reach_ns:
            return []
        self.handled.append(frame[1])
        if len(self.handled) > 2 * self.size:
            self.handled.popleft()
        return [(*frame, "matched", trigger, arrival, ns, gap)]


class _Pairing(StatefulProcessor):
    """Keeps the three buffers of a session as one value, as every access to state is a call out of the Python worker.

    Rows stay rows: a column of numbers and nulls in pandas would pass through floats, which do not hold nanoseconds.
    """

    def __init__(self, size: int, reach_ns: int, delay: int) -> None:
        self.limits = size, reach_ns, delay

    def init(self, handle) -> None:
        self.state = handle.getValueState("buffers", "detections array<long>, depths array<long>, handled array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        detections, depths, handled = self.state.get() or ([], [], [])
        pairs = [deque(zip(flat[::2], flat[1::2], strict=True)) for flat in (detections, depths)]
        buffers = Buffers(*self.limits, *pairs, deque(handled))
        for arrival, ns, is_depth in sorted(((r.arrival, r.ns, r.is_depth) for r in rows), key=lambda r: r[0]):
            for event in (buffers.depth if is_depth else buffers.detection)(arrival, ns):
                yield Row(*_NAMES)(key[0], *event)
        self.state.update((*[[n for pair in held for n in pair] for held in (buffers.detections, buffers.depths)], list(buffers.handled)))

    def close(self) -> None:
        pass


def live_pairs(messages: DataFrame, size: int, reach_ns: int, delay: int = 0) -> DataFrame:
    """What becomes of depth frames: a stream of ``OUTCOMES``.

    ``messages``: ``session`` (string), ``arrival`` (rising within a session), ``ns``, ``is_depth``. ``matched`` rows
    carry the detection and what triggered the match (``depth``, or ``detection`` where a frame was retried);
    ``evicted`` frames left the buffer unmatched, ``repeated`` ones have a stamp that was handled before. A frame
    without an outcome still waits. A session's state is bounded by the sizes of its buffers. The stream needs the
    RocksDB state store (``rocksdb_state``).
    """
    keyed = messages.select("session", "arrival", "ns", "is_depth").groupBy("session")
    return keyed.transformWithState(_Pairing(size, reach_ns, delay), outputStructType=OUTCOMES, outputMode="Append", timeMode="None")


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession, idle_batches: bool = True) -> Iterator[None]:
    """The state store that such streams need, for streams started in this block.

    Without ``idle_batches`` a stream runs batches for new rows only: one by processing time would else
    run for ever where it should end with its input.
    """
    wanted = {_PROVIDER: _ROCKSDB, _IDLE: str(idle_batches).lower()}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
