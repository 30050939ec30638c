import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelar.operators import asof, layout, semantics
from voxelar.sources import clouds, inference, readers
from voxelar.streaming import joins


def test_detection_log_skips_broken_lines(spark, tmp_path):
    good = {"stamp_sec": 2, "stamp_nanosec": 5, "detections": [{"class_id": 1, "class_name": "chair", "confidence": 0.9, "xyxy": [1, 2, 3, 4]}, {"class_name": "Person", "confidence": 0.9, "xyxy": [1, 2, 3, 4]}, {"confidence": 0.1, "xyxy": [1, 2, 3, 4]}]}
    lines = [json.dumps(good), "", "{broken", json.dumps({"detections": []}), json.dumps({"stamp_sec": 1, "stamp_nanosec": 0, "detections": []})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = readers.detection_log(spark, str(tmp_path / "log.jsonl"))
    assert [r.stamp_ns for r in log.collect()] == [1_000_000_000, 2_000_000_005]
    assert [(r.detection_id, r.class_name) for r in readers.detections(log, 0.25).collect()] == [(0, "chair")]


def test_trajectory_camera_and_manifest(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\n".join(" ".join(str(i + j) for j in range(16)) for i in range(3)))
    assert [(r.frame_id, r.pose[0]) for r in readers.trajectory(spark, str(tmp_path / "t.txt")).orderBy("frame_id").collect()] == [(0, 0.0), (1, 1.0), (2, 2.0)]
    (tmp_path / "c.json").write_text(json.dumps({"camera": {"fx": 1, "fy": 2, "cx": 3, "cy": 4}}))
    assert tuple(readers.camera(spark, str(tmp_path / "c.json")).first()) == (1, 2, 3, 4, 1000)
    files = spark.createDataFrame([(i, k) for i in (0, 2, 4, 8) for k in ("rgb", "depth")] + [(6, "rgb")], "frame_id long, kind string")
    assert [r.frame_id for r in readers.manifest(files, 10, 0, 2).collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        readers.manifest(files, 10, step=0)
    assert not readers.use_exported(spark.range(3).withColumnRenamed("id", "frame_id"), spark.createDataFrame([(0,)], "frame_id long"))


def test_vocabulary_limits(spark):
    lines = spark.createDataFrame([("# c",), (" chair ",), ("",), ("couch",)], "value string").coalesce(1)
    assert [tuple(r) for r in readers.vocabulary(lines).collect()] == [(0, "chair"), (1, "couch")]
    with pytest.raises(Exception, match="at most 80"):
        readers.vocabulary(spark.range(81).selectExpr("cast(id as string) as value")).collect()
    with pytest.raises(Exception, match="empty"):
        readers.vocabulary(lines.limit(0)).collect()


def test_cloud_messages_and_ply(spark, tmp_path):
    kind = np.dtype([("x", ">f4"), ("y", ">f4"), ("z", ">f4"), ("detection_id", ">u4")])
    data = np.array([(1, 2, 3, 2**32 - 1), (4, 5, 6, 0)], kind).tobytes()
    df = spark.createDataFrame([(9, bytearray(data))], "stamp_ns long, data binary")
    got = clouds.decode_clouds(df, {"x": 0, "y": 4, "z": 8, "detection_id": 12}, 16, big_endian=True).collect()
    assert [(r.x, r.detection_id) for r in got] == [(1.0, 2**32 - 1), (4.0, 0)]
    with pytest.raises(ValueError):
        clouds.decode_clouds(df, {"x": 0}, 16)
    spark.dataSource.register(clouds.PlySource)
    rows = spark.createDataFrame([(7, [(1.0, 2.0, 3.0)], [(1, 2, 3)])], "track_id int, points array<struct<x:float,y:float,z:float>>, colors array<struct<r:int,g:int,b:int>>")
    rows.write.format("ply").mode("append").save(str(tmp_path / "ply"))
    assert clouds.read_ply((tmp_path / "ply/object_000007.ply").read_bytes()).tolist() == [[1, 2, 3]]


def test_embeddings_are_padded(spark):
    rows = spark.createDataFrame([(1, [1.0] * 4)], "slot int, embedding array<float>")
    got = readers.padded_embeddings(rows, 3, 4).orderBy("slot").collect()
    assert [r.embedding[0] for r in got] == [0, 1, 0]


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 100)], "i long, t long")
    right = spark.createDataFrame([(10, 90), (11, 110), (12, 110), (9, 300)], "o long, s long")
    pick = lambda tie: asof.nearest_join(left, right, "i", "t", "s", "o", 50, tie=tie).first().o
    assert (pick("later"), pick("arrival")) == (11, 10)
    assert asof.nearest_join(left, right, "i", "t", "s", "o", 5, how="left").first().o is None


def test_poses_around_a_stamp_equal_brute_force(spark):
    """Buckets beside each other, repeated stamps (the largest pose counts), nulls and stamps before zero."""
    rng = random.Random(5)
    poses = [(rng.choice(["a", "b", None]), rng.randrange(-300, 300), rng.randrange(1000) / 10) for _ in range(150)]
    poses += [("a", 500, 1.0), ("a", 500, 5.0), ("b", 500, 5.0), ("b", 500, 1.0), ("a", None, 7.0), ("a", 510, None)]
    left = [(i, rng.choice(["a", "b", None]), rng.randrange(-320, 320)) for i in range(200)] + [(900, "a", 500), (901, "b", 500), (902, "a", None), (903, "a", 505)]
    found = asof.interpolated_pose(
        spark.createDataFrame(left, "id long, by string, ns long"), spark.createDataFrame(poses, "by string, at long, v double"), "id", "ns", "at", ["v"], 7, ["by"]
    )
    for i, by, ns, v in found.collect():
        near = [(at, x) for b, at, x in poses if b == by and by and at is not None and ns is not None and abs(at - ns) <= 7]
        low = max((p for p in near if p[0] <= ns), key=lambda p: (p[0], -1 if p[1] is None else p[1]), default=None)
        high = min((p for p in near if p[0] >= ns), key=lambda p: (p[0], 1 if p[1] is None else -p[1]), default=None)
        want = None
        if low and high and None not in (low[1], high[1]):
            want = low[1] + (high[1] - low[1]) * ((ns - low[0]) / (high[0] - low[0]) if high[0] > low[0] else 0.0)
        assert (v is None) == (want is None) and (v is None or abs(v - want) < 1e-9), (i, by, ns)
    assert found.count() == len(left)


def test_timing_report_arithmetic(spark):
    events = spark.createDataFrame([("sam_decoder", 0.125, 4)], "stage string, seconds double, calls int")
    report = semantics.timing_report(events, semantics.STAGES, 1.0, 2)
    row = report.where("stage = 'sam_decoder'").first()
    assert (row.share_percent, row.avg_ms_per_call, row.avg_ms_per_frame) == (12.5, 31.25, 62.5)
    totals = semantics.timing_totals(report, 1.0).first()
    assert (totals.unaccounted_seconds, totals.overlapped_seconds) == (0.875, 0.0)
    over = spark.createDataFrame([("detection", 0.8, 1), ("sam_encoder", 0.7, 1)], "stage string, seconds double, calls int")
    totals = semantics.timing_totals(semantics.timing_report(over, semantics.STAGES, 1.0, 1), 1.0).first()
    assert (totals.unaccounted_seconds, round(totals.overlapped_seconds, 9)) == (0.0, 0.5)


def test_stamped_streams_join_once(spark, tmp_path):
    rows = [json.dumps({"stamp_sec": s, "stamp_nanosec": 1, "detections": []}) for s in (1, 2, 2, 3)] + ["junk"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(rows))
    raw = spark.readStream.text(str(tmp_path / "in"))
    good, bad = joins.payload_stream(raw)
    assert bad.columns == ["value"]
    once = good.select("stamp_ns", "ts", F.lit(1).alias("n"))
    other = joins.payload_stream(spark.readStream.text(str(tmp_path / "in")))[0].select("stamp_ns", "ts", F.lit(2).alias("m"))
    q = joins.stamped_pairs(once, other).writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.stamp_ns // 10**9 for r in spark.table("paired").collect()) == [1, 2, 3]  # a repeated stamp of either side pairs once


def test_detector_boundary(spark):
    frames = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b""))], "frame_id long, content binary")
    got = inference.detect(frames, inference.stub).orderBy("frame_id").collect()
    assert [(r.frame_id, r.class_id, r.class_name, r.xyxy) for r in got] == [(1, 3, "unknown", [0, 0, 3, 1]), (2, 0, "unknown", [0, 0, 0, 1])]


def test_files_of_single_frames(spark, tmp_path):
    good = {"class_id": 3, "class_name": "cup", "confidence": 0.9, "xyxy": [0, 0, 1, 1]}
    payloads = {"000007.json": [good, good | {"class_name": "Person"}], "frame_12.json": [good | {"confidence": 0.1}, {"xyxy": [0, 0, 2, 2]}], "13.json": None}
    for name, found in payloads.items():
        (tmp_path / name).write_text(json.dumps({"detections": found} if found is not None else {}, indent=1))
    rows = readers.detection_files(spark, str(tmp_path), 0.0).collect()
    assert sorted((r.frame_id, r.detection_id, r.class_id, r.class_name) for r in rows) == [(7, 0, 3, "cup"), (12, 0, 3, "cup"), (12, 1, -1, "unknown")]
    assert readers.detection_files(spark, str(tmp_path), 0.5).count() == 1


def test_frames_meet_their_pose_and_depth_its_scale(spark):
    poses = spark.createDataFrame([(0, [1.0] * 16), (1, [2.0] * 16)], "frame_id long, pose array<double>")
    assert [r.frame_id for r in readers.with_poses(spark.range(1, 5).withColumnRenamed("id", "frame_id"), poses).collect()] == [1]
    row = spark.createDataFrame([(1500,)], "d int").select(readers.depth_metres(F.col("d"), 1000).alias("a"), readers.depth_metres(F.col("d"), 0.001, True).alias("b")).first()
    assert row.a == 1.5 and abs(row.b - 1.5) < 1e-12


def test_saved_objects_are_listed_as_a_viewer_does(spark, tmp_path):
    rows = [(t, f"c{t % 2}", n, float(x), 0.0, 1.0) for t, n in ((1, 5), (2, 9), (3, 9), (4, 1)) for x in range(3)] + [(5, "c1", 50, float("nan"), 0.0, 0.0), (2, "c0", 9, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "track_id long, class_name string, observations long, x double, y double, z double")
    clouds.write_objects(df, f"{tmp_path}/objects")
    found = clouds.saved_objects(spark, f"{tmp_path}/objects", least=2).collect()
    assert [(r.track_id, r.point_count, r.hi_x) for r in found] == [(2, 3, 2.0), (3, 3, 2.0), (1, 3, 2.0)]
    assert [r.track_id for r in clouds.saved_objects(spark, f"{tmp_path}/objects", 1, 1, ("c1",)).collect()] == [3]


def test_documents_of_a_run(spark, tmp_path):
    points = spark.createDataFrame([(1, 0.0, 0.0, 1.0, None), (1, 0.0, 0.0, 2.0, 255), (2, 1.0, 1.0, 1.0, None)], "track_id long, x double, y double, z double, rgb long")
    tracks = spark.createDataFrame([(1, 4, 0.5, 9, "confirmed"), (2, 5, 0.5, 1, "candidate")], "track_id long, class_id int, confidence double, observations long, status string")
    cloud = layout.fused_cloud(points, tracks).collect()
    assert len(cloud) == 2 and {r.track_id for r in cloud} == {1} and 255 in {r.rgb for r in cloud} and all(r.rgb is not None for r in cloud)
    timing = semantics.timing_report(spark.createDataFrame([("io", 1.0, 2)], "stage string, seconds double, calls int"), ("io", "fusion"), 2.0, 3)
    doc = json.loads(layout.run_summary(spark.range(5, 8).withColumnRenamed("id", "frame_id"), points, cloud and tracks, tracks.limit(0), timing, 2.0).first().value)
    assert (doc["frame_start"], doc["frame_count"], doc["frame_last"], doc["input_detections"], doc["objects"], doc["elapsed_seconds"]) == (5, 3, 7, 3, 0, 2.0)
    assert [t["stage"] for t in doc["timing"]] == ["io", "fusion"]
    a = spark.createDataFrame([("s", 1, 0), ("s", 0, 1), ("t", 0, 0)], "session string, frame long, observation long")
    clouds.write_associations(a, f"{tmp_path}/a")
    assert spark.read.json(f"{tmp_path}/a").count() == 3
