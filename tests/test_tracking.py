import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelar import queries
from voxelar.config import PROFILES, MapConfig
from voxelar.operators import cleaning, spatial
from voxelar.operators.boxes import assign, kept_boxes
from voxelar.streaming import tracker

CONFIG = MapConfig(voxel_size=0.01, overlap_radius=0.06, cluster_min_points=3, min_confirmed=2)


def plate(x=0.0, y=0.0, z=1.0):
    return np.array([(x + dx, y + dy, z) for dx in (-0.04, 0, 0.04) for dy in (-0.04, 0, 0.04)], np.float32)


def seen(x=0.0, class_id=56, name="chair", confidence=0.9, i=0, stamp=1.0):
    return {"observation": i, "class_id": class_id, "class_name": name, "confidence": confidence, "stamp": stamp, "points": plate(x)}


def test_same_object_is_confirmed():
    s = tracker.Session(CONFIG)
    first, second = s.step([seen()]), s.step([seen(0.01)])
    assert first[0]["is_new"] and not second[0]["is_new"]
    assert s.tracks[1]["status"] == "confirmed" and s.tracks[1]["count"] == 2


def test_one_track_is_not_used_twice():
    s = tracker.Session(CONFIG)
    s.step([seen()])
    assert len({r["track_id"] for r in s.step([seen(-0.01), seen(0.01, i=1)])}) == 2


def test_candidates_expire_and_confirmed_stay():
    s = tracker.Session(MapConfig(voxel_size=0.01, overlap_radius=0.06, max_missed=1, min_confirmed=2))
    s.step([seen()])
    s.step([])
    s.step([])
    assert not s.tracks
    for o in ([seen()], [seen()], [], [], []):
        s.step(o)
    assert len(s.tracks) == 1


def test_class_follows_the_evidence():
    s = tracker.Session(MapConfig(voxel_size=0.01, overlap_radius=0.06, geometry_weight=1, semantic_weight=0, association_threshold=0.1))
    s.step([seen(confidence=0.2)])
    s.step([seen(class_id=57, name="couch")])
    assert s.tracks[1]["class_name"] == "couch"


def test_doubles_merge_into_the_smaller_id():
    s = tracker.Session(MapConfig(voxel_size=0.01, overlap_radius=0.06, merge_interval=1))
    s._open(seen() | {"cloud": tracker.Cloud(plate(), 0)})
    s._open(seen(0.005) | {"cloud": tracker.Cloud(plate(0.005), 0)})
    s.step([])
    assert list(s.tracks) == [1] and s.tracks[1]["count"] == 2


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 5, 2)
        scores = np.where(rng.random((n, m)) < 0.7, rng.random((n, m)), -np.inf)
        best = (0, 0.0)
        for k in range(min(n, m) + 1):
            for r in itertools.combinations(range(n), k):
                for c in itertools.permutations(range(m), k):
                    total = sum(scores[a, b] for a, b in zip(r, c, strict=True))
                    if np.isfinite(total):
                        best = max(best, (k, total))
        got = assign(scores)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == best[0]
        assert sum(scores[p] for p in got) == pytest.approx(best[1])


def test_suppression_keeps_boxes_at_the_threshold():
    boxes = np.array([[0, 0, 10, 10], [0, 0, 10, 5], [20, 20, 30, 30], [0, 0, 0, 0], [0, 0, 10, 9]], float)
    assert kept_boxes(boxes, 0.5).tolist() == [True, True, True, True, False]


def test_profiles_and_limits():
    assert PROFILES["offline"].min_confirmed == 8
    with pytest.raises(ValueError):
        MapConfig(voxel_size=0)


def frames():
    rng = np.random.default_rng(3)
    rows = []
    for session, f in itertools.product("ab", range(12)):
        for i in range(3):
            points = [{"x": float(p[0]), "y": float(p[1]), "z": float(p[2])} for p in plate(i + rng.normal(0, 0.004))]
            rows.append((session, f, i, 56 + i, f"c{i}", 0.9, float(f + 1), points, datetime(2024, 1, 1) + timedelta(seconds=f)))
    return rows


SCHEMA = (
    "session string, frame long, observation long, class_id int, class_name string, confidence double, stamp double,"
    " points array<struct<x:float,y:float,z:float>>, ts timestamp"
)


def test_stream_equals_batch(spark, tmp_path):
    batch = tracker.track_batch(spark.createDataFrame(frames(), SCHEMA).drop("ts"), CONFIG).toPandas()
    assert len(batch) == 72 and batch.track_id.nunique() == 3
    last = [("a", 99, 0, 1, "end", 0.9, 99.0, [], datetime(2024, 2, 1)), ("b", 99, 0, 1, "end", 0.9, 99.0, [], datetime(2024, 2, 1))]
    for i, part in enumerate((frames()[:30] + frames()[36:50], frames()[30:36] + frames()[50:], last)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = tracker.track_stream(stream, CONFIG, "20 seconds")
    q = found.writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.table("tracked").toPandas()
    key = ["session", "frame", "observation"]
    both = batch.merge(got, on=key, suffixes=("", "_s"))
    assert len(got) == len(both) == 72 and (both.track_id == both.track_id_s).all()


def test_near_share_by_cells_and_by_hand():
    rng = np.random.default_rng(2)
    for n, m in ((1500, 700), (400, 900)):
        a, b = rng.normal(0, 1, (n, 3)).astype(np.float32), rng.normal(0.3, 1, (m, 3)).astype(np.float32)
        want = [(((p - b) ** 2).sum(axis=1).min() <= 0.2 * 0.2) for p in a]
        assert tracker.near_share(a, b, 0.2) == pytest.approx(np.mean(want))
    assert tracker.near_share(a, b[:0], 0.2) == 0.0


def test_main_cluster_is_the_operators(spark):
    rng = np.random.default_rng(4)
    clouds = [np.concatenate([rng.normal(0, 0.05, (40, 3)), rng.normal(1, 0.05, (30, 3)), rng.uniform(-3, 3, (15, 3))]), rng.uniform(-9, 9, (20, 3)), rng.normal(0, 0.01, (3, 3))]
    rows = [(i, i * 1000 + j, *map(float, p)) for i, c in enumerate(clouds) for j, p in enumerate(c)]
    df = spark.createDataFrame(rows, "cloud long, ord long, x double, y double, z double")
    kept = {r.ord: r.kept for r in spatial.largest_cluster(df, 0.12, 4, "ord", ["cloud"]).collect()}
    for i, c in enumerate(clouds):
        assert tracker.main_cluster(c, 0.12, 4).tolist() == [kept[i * 1000 + j] for j in range(len(c))]


def test_live_tracks_are_denoised():
    far = plate() + np.float32(5)
    for interval, size in ((0, 18), (1, 9)):
        s = tracker.Session(MapConfig(voxel_size=0.01, overlap_radius=0.06, cluster_min_points=3, denoise_interval=interval, max_centroid_distance=10, max_extent_growth=1000))
        s._open(seen() | {"cloud": tracker.Cloud(np.concatenate([plate(), far[:4], far[4:]]), 0)})
        s.step([])
        assert len(s.tracks[1]["cloud"].points) == size


def test_observations_are_cleaned(spark):
    rows = [("s", 0, i, *map(float, p)) for i, c in enumerate((plate(), plate()[:2], np.concatenate([plate(), plate() + 3, plate(0.1)]))) for p in c]
    df = spark.createDataFrame(rows + rows[:1], "session string, frame long, observation long, x double, y double, z double")
    got = {r.observation: len(r.points) for r in cleaning.clean_observations(df, CONFIG).collect()}
    assert got == {0: 9, 2: 18}
    assert cleaning.clean_observations(df.limit(0), CONFIG).count() == 0


def test_query_of_suppression_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    kept = {r.ord for r in queries.nms(spark, sf).collect()}
    boxes = queries._boxes(spark, sf).join(queries.read(spark, sf, "orders"), "o_orderkey").collect()
    groups = {}
    for r in boxes:
        x, y = sorted((r.x1, r.x2)), sorted((r.y1, r.y2))
        groups.setdefault((r.o_orderkey // 64, r.o_orderpriority), []).append((-r.o_totalprice, r.o_orderkey, x, y))
    want = set()
    for members in groups.values():
        chosen = []
        for _, key, x, y in sorted(members):
            area = (x[1] - x[0]) * (y[1] - y[0])
            for _, u, v in chosen:
                shared = max(0, min(x[1], u[1]) - max(x[0], u[0])) * max(0, min(y[1], v[1]) - max(y[0], v[0]))
                if shared > 0 and shared / (area + (u[1] - u[0]) * (v[1] - v[0]) - shared) > 0.45:
                    break
            else:
                chosen.append((key, x, y))
        want |= {c[0] for c in chosen}
    assert kept == want and len(want) < len(boxes)


def test_query_of_assignment_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    got, frames_ = {}, {}
    for r in queries.assignment(spark, sf).collect():
        got.setdefault(r.frame, []).append(r)
    e = queries.read(spark, sf, "events").selectExpr("event_id div 40 as frame", "user_id % 12 as o", "hash(event_type) as t", "value").groupBy("frame", "o", "t").agg(F.max("value").alias("v"))
    for r in e.collect():
        frames_.setdefault(r.frame, {}).setdefault(r.o, {})[r.t] = r.v
    assert set(got) == set(frames_)
    for frame, rows in frames_.items():
        best = {frozenset(): (0, 0.0)}  # most pairs, then the greatest sum, by the set of tracks taken
        for scores in rows.values():
            for used, (n, total) in list(best.items()):
                for t, v in scores.items():
                    if t not in used:
                        key, value = used | {t}, (n + 1, total + v)
                        best[key] = max(best.get(key, value), value)
        n, total = max(best.values())
        chosen = got[frame]
        assert len(chosen) == n == len({r.observation for r in chosen}) == len({r.track for r in chosen})
        assert sum(r.score for r in chosen) == pytest.approx(total)


def test_query_of_the_tracker_by_hand(spark):
    """The streamed batch against a session stepped frame by frame, every pair compared by points."""
    sf = "/root/testdata/sf0.001"
    got = {r.observation: r for r in queries.tracker_batch(spark, sf).collect()}
    rows = queries._observations(spark, sf).toPandas()
    assert rows.session.nunique() == 1 and len(rows) == len(got)
    session, seen_ = tracker.Session(queries.TRACKING), 0
    for _, frame in rows.groupby("frame"):
        for r in session.step(tracker._observations(frame)):
            assert got[r["observation"]].track_id == r["track_id"] and got[r["observation"]].is_new == r["is_new"]
            seen_ += 1
    assert seen_ == len(got)
    assert {r.observation: r.track_id for r in queries.tracker_stream(spark, sf).collect()} == {k: r.track_id for k, r in got.items()}
