"""Object tracks as keyed state: the same step drives batch groups and streams.

Cleaning (``clean_observations``), projection and everything else that does not depend on
earlier frames runs before, as joins and aggregations over all frames. Only the step itself
is sequential; it sees one frame's few observations and its session's live tracks.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelar.config import MapConfig
from voxelar.operators.boxes import assign
from voxelar.operators.spatial import LEAST_CLUSTER, NEIGHBOURS
from voxelar.plans.groups import whole_groups

ASSOCIATIONS = (
    "session string, frame long, observation long, track_id long, score double, overlap double, similarity double,"
    " box_overlap double, is_new boolean"
)


def _cells(points: np.ndarray, size: float) -> np.ndarray:
    return np.floor(points / np.float32(size)).astype(np.int64)


def blended(old: np.ndarray, new: np.ndarray, size: float) -> np.ndarray:
    """Two voxelised clouds as one; a shared voxel takes the midpoint."""
    both = np.concatenate([old, new])
    keys, inverse, n = np.unique(_cells(both, size), axis=0, return_inverse=True, return_counts=True)
    sums = np.zeros((len(keys), 3))
    np.add.at(sums, inverse.ravel(), both)
    return (sums / n[:, None]).astype(np.float32)


def near_share(a: np.ndarray, b: np.ndarray, radius: float) -> float:
    """The share of ``a`` with a point of ``b`` within the radius."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) * len(b) <= 1 << 16:
        return float((((a[:, None] - b[None]) ** 2).sum(axis=2).min(axis=1) <= radius * radius).mean())
    at, to = (np.floor(p / np.float64(radius)).astype(np.int64) for p in (a, b))
    low = np.minimum(at.min(axis=0), to.min(axis=0)) - 1
    width = np.maximum(at.max(axis=0), to.max(axis=0)) - low + 2
    number = lambda c: ((c[:, 0] - low[0]) * width[1] + c[:, 1] - low[1]) * width[2] + c[:, 2] - low[2]
    order = np.argsort(number(to), kind="stable")
    cells, b = number(to)[order], b[order]
    near = np.zeros(len(a), bool)
    for step in itertools.product((-1, 0, 1), repeat=3):
        todo = np.flatnonzero(~near)
        wanted = number(at[todo] + np.array(step))
        first, last = np.searchsorted(cells, wanted, "left"), np.searchsorted(cells, wanted, "right")
        count = last - first
        who = np.repeat(np.arange(len(todo)), count)
        other = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + first[who]
        near[todo[who[((a[todo[who]] - b[other]) ** 2).sum(axis=1) <= radius * radius]]] = True
    return float(near.mean())


def main_cluster(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Which points ``largest_cluster`` keeps of one cloud, by its rules."""
    n, least = len(points), max(1, least)
    everything = np.ones(n, bool)
    if eps <= 0 or n < least:
        return everything
    lists = []
    for i in range(0, n, 256):
        d2 = ((points[i : i + 256, None].astype(float) - points[None].astype(float)) ** 2).sum(axis=2)
        for row in d2:
            beside = np.flatnonzero(row < eps * eps)
            lists.append(beside[np.lexsort((beside, row[beside]))][: max(least, NEIGHBOURS)])
    core = np.array([len(x) >= least for x in lists])
    if not core.any():
        return everything
    label = np.where(core, np.arange(n), n)
    a = np.concatenate([np.full(len(x), i) for i, x in enumerate(lists) if core[i]])
    b = np.concatenate([x for i, x in enumerate(lists) if core[i]])
    a, b = a[core[b]], b[core[b]]
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    for i in np.flatnonzero(~core):
        if len(cores := lists[i][core[lists[i]]]):
            label[i] = label[cores[0]]
    sizes = np.bincount(label[label < n], minlength=n)
    best = int(np.argmax(sizes))
    return label == best if sizes[best] >= LEAST_CLUSTER else everything


class Cloud:
    """Points with the summaries an association looks at."""

    def __init__(self, points: np.ndarray, most: int):
        self.points = points
        self.center, self.low, self.high = points.mean(axis=0), points.min(axis=0), points.max(axis=0)
        few = 0 < most < len(points)
        self.search = points[np.linspace(0, len(points) - 1, most).astype(np.int64)] if few else points

    def overlap(self, other: Cloud, radius: float) -> float:
        return max(near_share(self.search, other.search, radius), near_share(other.search, self.search, radius))

    def beside(self, other: Cloud, config: MapConfig) -> bool:
        apart = np.linalg.norm(self.center - other.center) > config.max_centroid_distance
        reach = config.overlap_radius
        return not apart and bool((self.low <= other.high + reach).all() and (other.low <= self.high + reach).all())

    def box_overlap(self, other: Cloud) -> float:
        shared = np.clip(np.minimum(self.high, other.high) - np.maximum(self.low, other.low), 0, None).prod()
        return float(shared / min(np.maximum(c.high - c.low, 0.02).prod() for c in (self, other)))

    def may_take(self, other: Cloud, config: MapConfig) -> bool:
        merged = np.maximum(self.high, other.high) - np.minimum(self.low, other.low)
        limit = np.maximum(self.high - self.low, config.voxel_size) * max(1.0, config.max_extent_growth)
        return bool((merged <= limit + config.overlap_radius).all())


class Session:
    """The live tracks of one session. Every track is a plain dict, in order of creation."""

    def __init__(self, config: MapConfig):
        self.config, self.tracks, self.next_id, self.frames = config, {}, 1, 0

    def step(self, observations: list[dict]) -> list[dict]:
        """Take in a frame; one row for each observation, by its place in the frame."""
        c = self.config
        self.frames += 1
        stamp = max((o["stamp"] for o in observations), default=0.0)
        for t in self.tracks.values():
            t["missed"] += 1
        seen = [o | {"cloud": Cloud(o["points"], c.association_max_points)} for o in observations if len(o["points"]) >= 3]
        rows = []
        matched = self._match(seen)
        for i, o in enumerate(seen):
            if i in matched:
                track_id, detail = matched[i]
                self._absorb(self.tracks[track_id], o)
            else:
                track_id, detail = self._open(o), (1.0, 1.0, 1.0, 1.0)
            rows.append({"observation": o["observation"], "track_id": track_id, "is_new": i not in matched} | dict(zip(("score", "overlap", "similarity", "box_overlap"), detail, strict=True)))
        self._expire(stamp)
        if c.merge_interval and self.frames % c.merge_interval == 0:
            moved = self._merge_doubles()
            rows = [r | {"track_id": moved.get(r["track_id"], r["track_id"])} for r in rows]
        if c.denoise_interval and self.frames % c.denoise_interval == 0:
            for t in self.tracks.values():
                points = t["cloud"].points
                t["cloud"] = Cloud(points[main_cluster(points, c.cluster_eps, c.cluster_min_points)], c.association_max_points)
        return sorted(rows, key=lambda r: r["observation"])

    def _similarity(self, o: dict, t: dict) -> float:
        if o["class_id"] < 0:
            return float(o["class_name"] == t["class_name"])
        total = sum(t["scores"].values())
        return t["scores"].get(o["class_id"], 0.0) / total if total > 0 else float(o["class_id"] == t["class_id"])

    def _match(self, seen: list[dict]) -> dict[int, tuple[int, tuple[float, ...]]]:
        c, ids, details = self.config, sorted(self.tracks), {}
        weight = c.geometry_weight / (c.geometry_weight + c.semantic_weight)
        scores = np.full((len(seen), len(ids)), -np.inf)
        if not seen or not ids:
            return {}
        center, low, high = (np.array([getattr(self.tracks[k]["cloud"], a) for k in ids]) for a in ("center", "low", "high"))
        for i, o in enumerate(seen):
            # All tracks at once: what ``beside`` asks of each.
            cloud, reach = o["cloud"], c.overlap_radius
            near = np.linalg.norm(center - cloud.center, axis=1) <= c.max_centroid_distance
            near &= ((cloud.low <= high + reach) & (low <= cloud.high + reach)).all(axis=1)
            for j in np.flatnonzero(near):
                t = self.tracks[ids[j]]
                box, overlap = o["cloud"].box_overlap(t["cloud"]), 0.0
                if box >= c.min_box_overlap:
                    overlap = o["cloud"].overlap(t["cloud"], c.overlap_radius)
                if box < c.min_box_overlap or overlap < c.min_geometric_overlap:
                    continue
                similar = self._similarity(o, t)
                score = weight * overlap + (1 - weight) * similar
                if score >= c.association_threshold and t["cloud"].may_take(o["cloud"], c):
                    scores[i, j], details[i, int(j)] = score, (score, overlap, similar, box)
        return {i: (ids[j], details[i, j]) for i, j in assign(scores)}

    def _evidence(self, t: dict, scores: dict, names: dict) -> None:
        for k, v in scores.items():
            t["scores"][k] = t["scores"].get(k, 0.0) + v
        t["names"].update(names)
        t["class_id"] = max(t["scores"], key=t["scores"].get)
        t["class_name"] = t["names"].get(t["class_id"], t["class_name"])
        t["status"] = "confirmed" if t["count"] >= max(1, self.config.min_confirmed) else "candidate"

    def _open(self, o: dict) -> int:
        track_id, self.next_id = self.next_id, self.next_id + 1
        t = {"class_id": o["class_id"], "class_name": o["class_name"], "confidence": o["confidence"], "first": o["stamp"], "last": o["stamp"], "count": 1, "missed": 0, "cloud": o["cloud"], "scores": {}, "names": {}}
        self.tracks[track_id] = t
        self._evidence(t, {o["class_id"]: max(0.0, o["confidence"])}, {o["class_id"]: o["class_name"]})
        return track_id

    def _absorb(self, t: dict, o: dict) -> None:
        t["confidence"] = (t["confidence"] * t["count"] + o["confidence"]) / (t["count"] + 1)
        t["count"], t["missed"], t["last"] = t["count"] + 1, 0, max(t["last"], o["stamp"])
        points = blended(t["cloud"].points, o["points"], self.config.voxel_size) if o.get("fuse", True) else o["points"]
        t["cloud"] = Cloud(points, self.config.association_max_points)
        self._evidence(t, {o["class_id"]: max(0.0, o["confidence"])}, {o["class_id"]: o["class_name"]})

    def _expire(self, stamp: float) -> None:
        c = self.config
        old = lambda t: c.stale_after > 0 and stamp > 0 and stamp - t["last"] > c.stale_after
        lost = lambda t: t["status"] == "candidate" and t["missed"] > c.max_missed
        self.tracks = {k: t for k, t in self.tracks.items() if not (lost(t) or old(t))}

    def _merge_doubles(self) -> dict[int, int]:
        c, ids = self.config, sorted(self.tracks)
        root = {k: k for k in ids}
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                x, y = self.tracks[a], self.tracks[b]
                if x["class_id"] == y["class_id"] and x["cloud"].beside(y["cloud"], c):
                    if x["cloud"].overlap(y["cloud"], c.overlap_radius) >= c.merge_overlap:
                        low, high = sorted((root[a], root[b]))
                        root = {k: low if r == high else r for k, r in root.items()}
        for k, r in root.items():
            if k != r:
                self._join(self.tracks[r], self.tracks.pop(k))
        return {k: r for k, r in root.items() if k != r}

    def _join(self, t: dict, s: dict) -> None:
        n = t["count"] + s["count"]
        t["confidence"] = (t["confidence"] * t["count"] + s["confidence"] * s["count"]) / n
        t |= {"count": n, "first": min(t["first"], s["first"]), "last": max(t["last"], s["last"]), "missed": min(t["missed"], s["missed"])}
        t["cloud"] = Cloud(blended(t["cloud"].points, s["cloud"].points, self.config.voxel_size), self.config.association_max_points)
        self._evidence(t, s["scores"], s["names"])


def _observations(rows: pd.DataFrame) -> list[dict]:
    out = []
    for r in rows.sort_values("observation").to_dict("records"):
        points = np.array([tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in r["points"]], np.float32).reshape(-1, 3)
        out.append(r | {"points": points})
    return out


def _stepped(session: Session, key: str, frames) -> list[dict]:
    return [{"session": key, "frame": int(f)} | row for f, rows in frames for row in session.step(_observations(rows))]


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ASSOCIATIONS.split(", ")])


def track_batch(observations: DataFrame, config: MapConfig = MapConfig()) -> DataFrame:
    """Associations of all sessions; a session's frames stream by in order.

    ``observations``: ``session, frame, observation, class_id, class_name, confidence,
    stamp, points``, cleaned. Frames without observations do not appear and do not age
    tracks. A task holds one batch of frames and one session's live tracks; the number of
    sessions bounds how many tasks can work at once.
    """

    def run(batches):
        key, session = None, None
        for rows in whole_groups(batches, ["session", "frame"]):
            out = []
            for (name, frame), one in rows.groupby(["session", "frame"], sort=True):
                if name != key:
                    key, session = name, Session(config)
                out += _stepped(session, name, [(frame, one)])
            yield _frame(out)

    dealt = observations.repartition("session").sortWithinPartitions("session", "frame", "observation")
    return dealt.mapInPandas(run, ASSOCIATIONS)


def track_stream(observations: DataFrame, config: MapConfig = MapConfig(), delay: str = "1 second") -> DataFrame:
    """The same on a stream with event-time column ``ts``: frames wait until the watermark passes them.

    Late frames are dropped by the watermark; state holds the session and its waiting frames.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, waiting = pickle.loads(state.get[0]) if state.exists else (Session(config), None)
        parts = ([] if waiting is None else [waiting]) + ([] if state.hasTimedOut else list(batches))
        rows = pd.concat(parts) if parts else _frame([])
        mark = state.getCurrentWatermarkMs()
        due = rows["ts"].astype("datetime64[ms]").astype("int64") < mark if len(rows) else pd.Series([], dtype=bool)
        out = _stepped(session, key[0], rows[due].groupby("frame", sort=True)) if len(rows) else []
        rest = rows[~due] if len(rows) else None
        state.update((pickle.dumps((session, rest)),))
        if rest is not None and len(rest):
            state.setTimeoutTimestamp(max(mark + 1, int(rest["ts"].astype("datetime64[ms]").astype("int64").min()) + 1))
        yield _frame(out)

    kept = observations.withWatermark("ts", delay)
    return kept.groupBy("session").applyInPandasWithState(one, ASSOCIATIONS, "data binary", "append", GroupStateTimeout.EventTimeTimeout)
