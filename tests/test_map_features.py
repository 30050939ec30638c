"""Frame trees, rasters, density clusters, suppression, live buffers, snapshots, recordings, stored voxels, counters: brute force and failures."""

import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelar.operators import boxes, density, frames, raster, spatial, voxels
from voxelar.operators.voxels import CELLS, with_cells
from voxelar.plans.counters import RunCounters
from voxelar.sources import recordings, snapshots
from voxelar.streaming import live, quarantine, tracker

# --- frames

POSE = "x double, y double, z double, qx double, qy double, qz double, qw double"


def matrix(p):
    t, q = np.array(p[:3]), np.array(p[3:]) / np.linalg.norm(p[3:])
    x, y, z, w = q
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = t
    return m


def test_poses_along_a_path_equal_a_hand_composition(spark):
    rng = random.Random(2)
    edges = [("map", "odom"), ("odom", "base"), ("base", "arm"), ("arm", "hand"), ("hand", "camera"), ("base", "lidar")]
    poses = {c: [rng.gauss(0, 2) for _ in range(3)] + [rng.gauss(0, 1) for _ in range(4)] for _, c in edges}
    up = dict((c, p) for p, c in edges)

    def above(f):
        return matrix([0, 0, 0, 0, 0, 0, 1]) if f == "map" else above(up[f]) @ matrix(poses[f])

    fixed = spark.createDataFrame([(p, c, *map(float, poses[c])) for p, c in edges if c in ("arm", "lidar")], f"parent string, child string, {POSE}")
    # The same pose before and after each stamp: what is between is the pose itself, up to sign.
    moving = [(p, c, t, *map(float, poses[c][:3]), *[s * float(v) for v in poses[c][3:]]) for p, c in edges if c not in ("arm", "lidar") for t, s in ((0, 1.0), (100, -1.0))]
    transforms = spark.createDataFrame([m for m in moving if m[1] != "hand"] + [m for m in moving if m[1] == "hand" and m[2] == 0], f"parent string, child string, ns long, {POSE}")
    names = ["map", "odom", "base", "arm", "hand", "camera", "lidar", "moon"]
    asked = [(i, s, t, 50 if "hand" not in (s, t) and "camera" not in (s, t) else 0, ) for i, (s, t) in enumerate((s, t) for s in names for t in names)]
    asked.append((1000, "camera", "map", 50))  # hand has no sample after this
    asked.append((1001, "odom", "map", 101))  # beyond the last
    found = frames.lookup_transforms(spark.createDataFrame(asked, "lookup long, source string, target string, ns long"), transforms, fixed, 100)
    got = {r.lookup: r for r in found.collect()}
    assert len(got) == len(asked) and got[1000].x is None and got[1001].x is None
    for i, s, t, _ in asked[:-2]:
        if (s == "moon") != (t == "moon"):
            assert got[i].x is None
            continue
        want = np.eye(4) if s == t else np.linalg.inv(above(t)) @ above(s)
        assert np.allclose(matrix([got[i][c] for c in ("x", "y", "z", "qx", "qy", "qz", "qw")]), want, atol=1e-9), (s, t)


def test_trees_that_are_none_are_errors(spark):
    link = lambda *rows: spark.createDataFrame(rows, "parent string, child string")
    with pytest.raises(ValueError, match="cycle"):
        frames.ancestors(link(("a", "b"), ("b", "c"), ("c", "a")))
    with pytest.raises(ValueError, match="two parents"):
        frames.ancestors(link(("a", "c"), ("b", "c")))
    chain = frames.ancestors(link(*[(f"f{i}", f"f{i + 1}") for i in range(20)]))
    assert chain.count() == 21 * 22 // 2 and chain.where("frame = 'f20' and ancestor = 'f0'").first().depth == 20


# --- rasters


def test_raster_equals_a_painter(spark):
    rng = np.random.default_rng(4)
    n, size = 600, 60
    xy, rank = rng.uniform(0, 1, (n, 2)).round(2), rng.integers(0, 4, n)
    fit = spark.createDataFrame([(0.0, 0.0, size - 1.0, 0.0, 0.0, size, size)], "min_x double, min_y double, scale double, offset_x double, offset_y double, width int, height int")
    points = spark.createDataFrame([(int(k), i, float(x), float(y)) for i, (k, (x, y)) in enumerate(zip(rank, xy, strict=True))], "track int, ord int, x double, y double")
    dots = raster.point_pixels(points, fit, F.col("track"), "ord", F.col("ord") + 1, radius=2)
    bounds = points.groupBy("track").agg(*[f(a).alias(f"{p}_{a}") for a in "xy" for p, f in (("lo", F.min), ("hi", F.max))])
    got = raster.raster(dots, raster.box_pixels(bounds, fit, F.col("track"), F.lit(5000) + F.col("track")))
    image = np.zeros((size, size), int)
    u, v = np.rint(xy[:, 0] * (size - 1)).astype(int), np.rint(size - 1 - xy[:, 1] * (size - 1)).astype(int)
    arms = [(0, 0), *[(d * i, d * j) for d in (1, 2) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]]
    for k in range(4):
        for dx, dy in arms:
            for i in np.flatnonzero(rank == k):
                image[np.clip(v[i] + dy, 0, size - 1), np.clip(u[i] + dx, 0, size - 1)] = i + 1
    for k in range(4):
        a, b, c, d = u[rank == k].min(), u[rank == k].max(), v[rank == k].min(), v[rank == k].max()
        for w in (0, 1):
            image[c + w, a + w : b - w + 1] = image[d - w, a + w : b - w + 1] = 5000 + k
            image[c + w : d - w + 1, a + w] = image[c + w : d - w + 1, b - w] = 5000 + k
    assert {(r.u, r.v): r.rgb for r in got.collect()} == {(x, y): image[y, x] for y, x in zip(*np.nonzero(image), strict=True)}
    painted = {(r.tile_u, r.tile_v): np.frombuffer(r.image, np.uint8).reshape(32, 32, 3) for r in raster.tiles(got, side=32).collect()}
    for y, x in zip(*np.nonzero(image), strict=True):
        r, g, b = painted[x // 32, y // 32][y % 32, x % 32].tolist()
        assert (r << 16 | g << 8 | b) == image[y, x]


# --- density clusters


def clusters_by_hand(rows, eps, least):
    """rows: (group, id, x, y, z)."""
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True))
    near = {a[1]: [(d2(a, b), b[1]) for b in rows if a[0] == b[0] and d2(a, b) < eps * eps] for a in rows}
    core = {i for i, n in near.items() if len(n) >= least}
    name = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min(name[j] for _, j in near[i] if j in core)
            if low < name[i]:
                name[i], changed = low, True
    border = {i: name[min(x for x in n if x[1] in core)[1]] for i, n in near.items() if i not in core and any(j in core for _, j in n)}
    return {a[1]: (a[1] in core, name.get(a[1], border.get(a[1]))) for a in rows}


@pytest.mark.parametrize("seed", [0, 1])
def test_density_clusters_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    spots = rng.uniform(-1, 1, (6, 3))
    xyz = np.concatenate([s + rng.normal(0, 0.05, (60, 3)) for s in spots] + [rng.uniform(-1, 1, (60, 3)), np.tile(spots[0], (30, 1)), np.arange(30)[:, None] * [0.099, 0, 0] + 3])
    rows = [(i % 2, i, *map(float, p)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(rows, "g int, i long, x double, y double, z double")
    for eps, least in ((0.1, 5), (0.2, 2)):
        got = {r.i: (r.core, r.cluster) for r in density.density_clusters(df, eps, least, "i", ["g"]).collect()}
        assert got == clusters_by_hand(rows, eps, least)


def test_density_equals_bounded_clusters_where_the_bound_does_not_bind(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i % 3, i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 1, (240, 3)))], "g int, i long, x double, y double, z double")
    want = spatial.largest_cluster(df, 0.2, 3, "i", ["g"], neighbours=240)
    assert density.largest_density_cluster(df, 0.2, 3, "i", ["g"]).exceptAll(want).count() == 0


def test_closed_clusters_link_points_at_the_radius(spark):
    xyz = [(0.0, 0.0, 0.0), (0.05, 0.0, 0.0), (0.1000001, 0.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(xyz)], "i long, x double, y double, z double")
    got = {r.i: r.cluster for r in density.density_clusters(df, 0.05, 1, "i", closed=True).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_neighbours_of_dense_points_are_ranked_from_few_pairs(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.uniform(0, 0.05, (600, 3)), np.tile([0.02, 0.02, 0.02], (100, 1)), [[5.0, 5.0, 5.0]]])
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "g int, i long, x double, y double, z double")
    d2 = ((xyz[:, None] - xyz[None]) ** 2) @ np.ones(3)
    want = {(a, int(b)) for a in range(len(xyz)) for b in np.lexsort((np.arange(len(xyz)), d2[a]))[:8] if d2[a, b] < 0.12**2}
    assert {(r.a, r.b) for r in spatial.bounded_knn(df, 0.12, 8, "i", ["g"]).collect()} == want
    assert spatial.close_pairs(df, 0.12, 8, "i", ["g"]).count() < 4 * 8 * len(xyz)  # of 490,001 pairs


def test_dense_points_are_compared_within_a_radius_that_holds_their_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.uniform(0, 0.2, (6000, 3)), rng.uniform(1, 1.1, (20, 3)), np.tile([0.1, 0.1, 0.1], (30, 1)), [[5.0, 5.0, 5.0]]])
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "g int, i long, x double, y double, z double")
    met, real = [], spatial.radius_pairs

    def counted(left, right, radius, by=(), strict=False):
        cells = [with_cells(side.select(*by, *"xyz"), radius).groupBy(*by, *CELLS).count() for side in (left, right)]
        near = spatial.around(cells[1].withColumnRenamed("count", "n"))
        met.append(cells[0].join(near, [*by, *CELLS]).agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0)
        return real(left, right, radius, by, strict)

    monkeypatch.setattr(spatial, "radius_pairs", counted)
    got = {(r.a, r.b) for r in spatial.bounded_knn(df, 0.12, 8, "i", ["g"]).collect()}
    want = set()
    for a, p in enumerate(xyz):
        d2 = ((xyz - p) ** 2) @ np.ones(3)
        want |= {(a, int(b)) for b in np.lexsort((np.arange(len(xyz)), d2))[:8] if d2[b] < 0.12**2}
    assert got == want
    assert sum(met) < 0.5 * len(xyz) ** 2  # twice all pairs before


def test_cores_by_counts_give_the_clusters_of_a_join(spark):
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.normal(0, 0.02, (300, 3)), rng.normal(1, 0.02, (90, 3)), rng.uniform(-1, 2, (200, 3)), np.tile([2.0, 2.0, 2.0], (40, 1))])
    rows = [(i % 3, i, *map(float, p)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame([*rows, (0, 9001, None, 0.0, 0.0), (1, 9002, float("nan"), 0.0, 0.0)], "g int, i long, x double, y double, z double")
    got = {r.i: r.kept for r in spatial.largest_cluster(df, 0.12, 4, "i", ["g"]).collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        kept = tracker.main_cluster(np.array([r[2:] for r in own]), 0.12, 4).tolist()
        assert kept == [got[r[1]] for r in own]
    assert got[9001] is False and got[9002] is False


def test_a_dense_cell_lists_no_pairs(spark):
    """Four thousand points in two neighbouring cells: sixteen million pairs, but one link."""
    rng = np.random.default_rng(6)
    xyz = np.concatenate([rng.uniform(0.001, 0.05, (2000, 3)), rng.uniform(0.001, 0.05, (2000, 3)) + [0.0577, 0, 0], [[0.3, 0, 0]]])
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "g int, i long, x double, y double, z double")
    sizes = []
    real = density.materialize

    def counted(frame, name):
        out = real(frame, name)
        sizes.append(out.count())
        return out

    density.materialize, before = counted, density.materialize
    try:
        got = density.density_clusters(df, 0.1, 4, "i", ["g"])
    finally:
        density.materialize = before
    assert max(sizes) <= 4001
    assert got.where("core").count() == 4000 and got.select("cluster").distinct().count() == 2


# --- suppression


def test_rounds_keep_what_the_greedy_kernel_keeps(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        x, y = rng.integers(0, 300, 2)
        w, h = rng.integers(0, 90, 2)
        rows.append((int(i % 5), i, float(rng.integers(0, 40)), float(x), float(y), float(x + w), float(y + h)))
    rows += [(9, 1000 + i, 1.0, 5.0, 5.0, 50.0, 50.0) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, ord long, confidence double, x1 double, y1 double, x2 double, y2 double")
    for threshold, tile in ((0.3, 64.0), (0.0, 1000.0)):
        a, b = boxes.suppress_rounds(df, threshold, ["g"], tile=tile), boxes.suppress(df, threshold, ["g"])
        assert sorted(r.ord for r in a.collect()) == sorted(r.ord for r in b.collect())
    assert boxes.suppress_rounds(df.limit(0), 0.5, ["g"]).count() == 0


# --- live buffers


def test_live_pairs_over_triggers_equal_one_simulation(spark, tmp_path):
    """Evictions, retries and repeated stamps; the stream stops after every batch and goes on from its checkpoint."""
    rng = random.Random(8)
    rows = [(s, i, rng.choice([i * 10, i * 10 + 3, i * 10 - 25]), rng.random() < 0.5) for s in ("a", "b", None) for i in range(90)]
    schema = "session string, arrival long, ns long, is_depth boolean"
    for delay in (0, 2):
        folder = tmp_path / f"d{delay}"
        for part in range(3):
            some = [r for r in rows if r[1] // 30 == part]
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            with live.rocksdb_state(spark):
                q = live.live_pairs(stream, 4, 12, delay).writeStream.option("checkpointLocation", f"{folder}/c")
                q.outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        want = []
        for s in ("a", "b", None):
            buffers = live.Buffers(4, 12, delay)
            for _, arrival, ns, is_depth in (r for r in rows if r[0] == s):
                want += [(s, *x) for x in (buffers.depth if is_depth else buffers.detection)(arrival, ns)]
        got = [tuple(r) for r in spark.read.schema(live.OUTCOMES).parquet(f"{folder}/out").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        kinds = Counter((r[3], r[4]) for r in want)
        assert kinds["evicted", "depth"] and kinds["matched", "depth"] and (kinds["matched", "detection"] > 0) == (delay == 0)


def test_live_pairs_keep_nanoseconds(spark, tmp_path):
    """Stamps beyond 2^53 beside evicted frames, whose columns are null."""
    first = 1_704_091_287_626_912_345
    rows = [("a", 0, first - 10**9, True), ("a", 1, first, False), ("a", 2, first + 1, True), ("a", 3, first + 10**9, True)]
    schema = "session string, arrival long, ns long, is_depth boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    with live.rocksdb_state(spark):
        q = live.live_pairs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1, 5).writeStream.option("checkpointLocation", f"{tmp_path}/c")
        q.outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = [tuple(r) for r in spark.read.schema(live.OUTCOMES).parquet(f"{tmp_path}/out").orderBy("arrival").collect()]
    assert got == [("a", 0, first - 10**9, "evicted", "depth", None, None, None), ("a", 2, first + 1, "matched", "depth", 1, first, 1)]


# --- quarantine


def test_batches_are_flagged_by_earlier_ones_alone(spark, tmp_path):
    ns = 1_700_000_000_000_000_000
    batches = [[ns + 5_999_999, ns - 10**12], [ns - 4_000_001, ns - 5_000_001, ns - 5_000_000], [ns + 10**9, ns - 4_000_001]]
    staged, marks = f"{tmp_path}/staged", f"{tmp_path}/marks"
    sink = quarantine.flagging(spark, staged, marks, 10)
    frames_ = [spark.createDataFrame([("cloud", i, v) for i, v in enumerate(b)], "side string, ref long, stamp_ns long") for b in batches]
    for number in (0, 1, 2, 1, 0, 2):  # batches repeat after a failure
        sink(frames_[number], number)
    got = {(r.number, r.ref): r.late for r in quarantine.flagged(spark, staged).withColumn("number", F.expr("int(regexp_extract(input_file_name(), 'staged/([0-9]+)/', 1))")).collect()}
    top = ns // 10**6 + 5
    want = {(b, i): b > 0 and v // 10**6 <= top - 10 for b, vs in enumerate(batches) for i, v in enumerate(vs)}
    assert got == want and set(got.values()) == {True, False}


# --- snapshots


def objects(spark, ids, points=3):
    rows = []
    for i in ids:
        record = {"track_id": i, "class_name": f"thing {i}", "class_id": 5, "times_seen": 4, "point_count": points, "semantic_scores": {"a": 0.5}}
        record |= {f"point_cloud_{k}": f"objects/object_{i:04d}_thing_{i}.{k}" for k in ("ply", "npz")}
        rows.append((json.dumps(record), [(float(j), float(i), 0.5) for j in range(points)], [(j, i, 7) for j in range(points)]))
    return spark.createDataFrame(rows, "record string, points array<struct<x:double,y:double,z:double>>, colors array<struct<r:int,g:int,b:int>>").repartition(3)


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_snapshots_replace_each_other(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert snapshots.read_snapshot(spark, folder).count() == 0
    for ids, points in (((1, 2, 3), 3), ((2, 4), 5), ((), 1)):
        snapshots.write_snapshot(objects(spark, ids, points) if ids else objects(spark, (9,)).limit(0), f"file://{folder}" if points == 5 else folder)
        rows = {r.track_id: r for r in snapshots.read_snapshot(spark, folder).collect()}
        assert sorted(rows) == sorted(ids) and snapshots.current_manifest(folder)["count"] == len(ids)
        named = {r[f"point_cloud_{k}"] for r in rows.values() for k in ("ply", "npz")}
        assert {f for f in files(folder) if f.endswith((".ply", ".npz"))} == named and not any(".tmp" in f for f in files(folder))
        for i, r in rows.items():
            with np.load(f"{folder}/{r.point_cloud_npz}") as z:
                assert z["points_map"].shape == (points, 3) and z["points_map"][1].tolist() == [1.0, i, 0.5] and z["rgb"][0].tolist() == [0, i, 7]
                assert int(z["track_id"]) == i and str(z["class_name"]) == f"thing {i}" and json.loads(str(z["semantic_scores"])) == {"a": 0.5}
            assert open(f"{folder}/{r.point_cloud_ply}", "rb").read().startswith(b"ply\nformat binary_little_endian 1.0\nelement vertex %d\n" % points)


def test_a_failed_snapshot_leaves_the_one_before(spark, tmp_path):
    folder = str(tmp_path / "s")
    snapshots.write_snapshot(objects(spark, (1, 2)), folder)
    before = files(folder)
    broken = objects(spark, (3, 4, 5)).withColumn("record", F.when(F.col("record").contains('"track_id": 5'), "no json").otherwise(F.col("record")))
    with pytest.raises(Exception, match="JSON|json|Expecting"):
        snapshots.write_snapshot(broken, folder)
    assert files(folder) == before and snapshots.read_snapshot(spark, folder).count() == 2


def test_a_stream_of_snapshots(spark, tmp_path):
    folder, source = str(tmp_path / "s"), str(tmp_path / "in")
    spark.dataSource.register(snapshots.ObjectSnapshot)
    for ids in ((1, 2), (2, 3)):
        objects(spark, ids).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(objects(spark, (1,)).schema).parquet(source)
        q = stream.writeStream.format("object_snapshot").option("path", folder).option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.track_id for r in snapshots.read_snapshot(spark, folder).collect()) == list(ids)


# --- recordings


def test_a_recording_is_read_once_over_restarts(spark, tmp_path):
    """Batches of seven messages; the stream is stopped and started anew, and files come in between."""
    folder, out, want = str(tmp_path / "r"), str(tmp_path / "out"), []
    batches = []
    for n in range(3):
        some = [(100 * n + i, bytes([n, i]) * (i % 5)) for i in range(20)]
        want += some
        recordings.write_recording(some, folder, f"{n:03d}")
        q = recordings.recording_stream(spark, folder, str(tmp_path / "p" / "offset.json"), 7).writeStream.option("checkpointLocation", str(tmp_path / "c")).start(out)
        try:
            q.processAllAvailable()
            batches += [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        finally:
            q.stop()
    got = [(r.stamp_ns, bytes(r.data)) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want) and max(batches) <= 7


def test_a_message_that_was_cut_off_is_not_read():
    raw = b"".join(recordings.HEAD.pack(i, 3) + b"abc" for i in range(3))
    assert len(recordings._heads(raw)) == 4
    assert len(recordings._heads(raw[:-1])) == 3 and len(recordings._heads(raw[:-8])) == 3 and recordings._heads(b"") == [0]


def test_partitions_of_a_batch_do_not_grow_with_it(tmp_path):
    """Messages are numbered by the counts beside the files; a file that was cut off is read instead."""
    rows = [(i, b"x" * (i % 4)) for i in range(40_000)]
    for n in range(8):
        recordings.write_recording(rows[n * 5000 : n * 5000 + 5000], str(tmp_path / "r"), f"{n:03d}")
    reader = recordings._Reader({"path": str(tmp_path / "r"), "progress": str(tmp_path / "p" / "o.json"), "max_messages": "39000"})
    end = reader.latestOffset()
    spans = reader.partitions({"message": 100}, end)
    assert end == {"message": 39_000} and len(spans) <= recordings.PARTITIONS
    got = [(r["stamp_ns"], r["data"]) for span in spans for batch in reader.read(span) for r in batch.to_pylist()]
    assert got == rows[100:39_000]
    last = tmp_path / "r" / "007.msg"
    last.write_bytes(last.read_bytes()[:-1])
    anew = recordings._Reader({"path": str(tmp_path / "r"), "progress": str(tmp_path / "p" / "o2.json"), "max_messages": "50000"})
    assert anew.latestOffset() == {"message": 39_999}


# --- stored voxels, counters


def test_stored_voxels_merge_without_an_exchange(spark, tmp_path):
    rng = np.random.default_rng(9)
    cloud = lambda far: spark.createDataFrame([tuple(map(float, p)) for p in np.concatenate([rng.uniform(-1, 1, (400, 3)), [[0.0, 0.0, 0.0], [far, 0, 0], [3e6, 3e6, 3e6]]])], "x double, y double, z double")
    a, b = cloud(2e6), cloud(-2e6)
    for name, df in (("vox_a", a), ("vox_b", b)):
        voxels.store_voxels(df, 0.25, name, 3, str(tmp_path))
    got = voxels.merge_stored(spark, "vox_a", "vox_b", 0.25)
    near = got.where("code is not null")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    columns = [*voxels.CELLS, "shared", *[F.round(c, 9).alias(c) for c in "xyz"]]
    want = voxels.merge_clouds(voxels.voxel_mean(a, 0.25), voxels.voxel_mean(b, 0.25), 0.25)
    assert got.select(*columns).exceptAll(want.select(*columns)).count() == 0 and got.count() == want.count()
    assert got.where("code is null").count() == 3 and got.where("code is null and shared").count() == 1
    for part in near.select(F.spark_partition_id().alias("p"), "code").groupBy("p").agg(F.collect_list("code").alias("codes")).collect():
        assert part.codes == sorted(part.codes)
    for name in ("vox_a", "vox_b"):
        spark.sql(f"drop table {name}")
        spark.sql(f"drop table {name}_far")


def test_counters_come_from_the_pass_itself(spark, tmp_path):
    seen = RunCounters()
    spark.range(100).write.parquet(f"{tmp_path}/t")
    kept = seen.watch(seen.watch(spark.read.parquet(f"{tmp_path}/t"), "raw").where("id % 3 = 0"), "kept", total=F.sum("id"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 2
    kept.write.format("noop").mode("overwrite").save()
    assert seen.counts() == {"raw": 100, "kept": 34, "kept_total": 1683}
    assert tuple(seen.row(spark).first()) == (100, 34, 1683)
    with pytest.raises(ValueError, match="already"):
        seen.watch(kept, "raw")
