import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelar import queries
from voxelar.functions import color, detection, geometry
from voxelar.operators import layout, projection, spatial, voxels

CAMERA = {"fx": 100.0, "fy": 100.0, "cx": 2.0, "cy": 1.0}


def cloud(spark, points, **more):
    frame = pd.DataFrame(np.asarray(points, float).reshape(-1, 3), columns=list("xyz"))
    return spark.createDataFrame(frame.assign(ord=range(len(frame)), **more))


def test_masked_depth_keeps_valid_pixels(spark):
    depth = spark.createDataFrame([(0, u, v, 0.0 if (v, u) == (1, 2) else 2.0) for v in range(4) for u in range(5)], "frame_id long, u int, v int, depth double")
    mask = spark.createDataFrame([(0, 0, u, 1) for u in (1, 2, 3)], "frame_id long, detection_id int, u int, v int")
    got = projection.project_masks(mask, depth, CAMERA, stride=1).orderBy("u").collect()
    assert [(r.u, r.v, r.z) for r in got] == [(1, 1, 2.0), (3, 1, 2.0)]
    assert got[0].x == pytest.approx(-0.02)


def test_stride_two_takes_a_quarter(spark):
    ones = spark.createDataFrame([(0, u, v, 1.0) for v in range(6) for u in range(6)], "frame_id long, u int, v int, depth double")
    mask = ones.select("frame_id", F.lit(0).alias("detection_id"), "u", "v")
    assert projection.project_masks(mask, ones, CAMERA).count() == 9


def test_box_grid_starts_at_the_corner_and_spans_tiles(spark):
    pixels = spark.createDataFrame([(0, u, v, 1.0) for v in range(130) for u in range(130)], "frame_id long, u int, v int, depth double")
    box = spark.createDataFrame([(0, 7, 3, 5, 130, 71)], "frame_id long, detection_id int, left int, top int, right int, bottom int")
    got = projection.project_boxes(box, pixels, CAMERA, stride=3).select("u", "v").toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted((u, v) for u in range(3, 130, 3) for v in range(5, 71, 3))


def test_box_scaling(spark):
    rows = [(10.0, 20.0, 110.0, 220.0), (110.0, 220.0, 10.0, 20.0), (4.0, 4.0, 4.0, 4.0), (float("nan"), 0.0, 1.0, 1.0), (-50.0, -50.0, 9999.0, 9999.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    corners = [F.col(c) for c in "abcd"]
    got = [r.box and tuple(r.box) for r in df.select(geometry.scaled_box(corners, [F.lit(640), F.lit(480)], [F.lit(320), F.lit(240)]).alias("box")).collect()]
    assert got == [(5, 10, 55, 110), (5, 10, 55, 110), None, None, (0, 0, 320, 240)]


def test_two_points_in_one_voxel_with_colors(spark):
    df = cloud(spark, [(0.01, 0, 0), (0.02, 0, 0)], r=[100, 200], g=[20, 40], b=[0, 10])
    row = voxels.voxel_mean(df, 0.1, colors=True).first()
    assert (row.r, row.g, row.b, row.n) == (150, 30, 5, 2) and row.x == pytest.approx(0.015)


def test_narrow_voxel_keys_follow_single_precision(spark):
    x = (np.arange(-2000, 2000) * np.float32(0.02)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", geometry.voxel_key(F.col("x"), 0.02, narrow=True).alias("k")).toPandas()
    assert (df.k == np.floor(df.x.to_numpy(np.float32) / np.float32(0.02)).astype(int)).all()


def test_fast_merge_equals_regrouping(spark):
    rng = np.random.default_rng(42)
    a, b = (voxels.voxel_mean(cloud(spark, rng.uniform(-2, 2, (500, 3))), 0.05).select("x", "y", "z") for _ in range(2))
    merged = voxels.merge_clouds(a, b, 0.05).toPandas()
    again = voxels.voxel_mean(a.unionByName(b), 0.05).toPandas()
    m, g = (d.sort_values(["kx", "ky", "kz"])[["x", "y", "z"]].to_numpy() for d in (merged, again))
    assert np.allclose(m, g)


def plate(x=0.0, y=0.0, z=1.0):
    return [(x + dx, y + dy, z) for dx in (-0.04, 0, 0.04) for dy in (-0.04, 0, 0.04)]


def test_shifted_plates_overlap(spark):
    df = cloud(spark, plate() + plate(0.02), label=[0] * 9 + [1] * 9)
    assert spatial.cloud_overlap(df, 0.03, "label", "ord").first().overlap > 0.8


def test_largest_cluster_drops_far_points(spark):
    line = [(i * 0.01 - 0.0, 0, 0) for i in range(20)] + [(2 + i * 0.016, 0, 0) for i in range(6)] + [(9, 9, 9)]
    got = spatial.largest_cluster(cloud(spark, line, g=0), 0.03, 3, "ord", ["g"]).where("kept").toPandas()
    assert sorted(got.ord) == list(range(20))


def test_cluster_without_core_keeps_all(spark):
    got = spatial.largest_cluster(cloud(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0)], g=0), 0.1, 3, "ord", ["g"])
    assert got.where("kept").count() == 3


def test_layout_scale_and_flip(spark):
    fit = layout.fit_layout(cloud(spark, [(0, 0, 0), (2, 1, 0)]), 100, 0, 1, 1000)
    df = cloud(spark, [(0, 0, 0), (2, 1, 0)]).crossJoin(fit)
    (a, b) = df.select("ord", *[c.alias(n) for n, c in geometry.to_pixel(F.col("x"), F.col("y")).items()]).orderBy("ord").collect()
    assert (b.u - a.u, a.v - b.v) == (200, 100)


def test_layout_caps_the_canvas(spark):
    row = layout.fit_layout(cloud(spark, [(0, 0, 0), (100, 20, 0)]), 100, 0, 100, 1000).first()
    assert row.width == 1000 and row.scale == pytest.approx(9.99)


def test_bounds_ignore_unfinished_rows_and_need_one(spark):
    row = layout.xy_bounds(cloud(spark, [(1, 2, 0), (3, -1, 0), (float("nan"), 0, 0)])).first()
    assert tuple(row) == (1, 3, -1, 2)
    with pytest.raises(Exception, match="no finite"):
        layout.xy_bounds(cloud(spark, [(float("nan"), 0, 0)])).collect()


def test_object_record_and_map(spark):
    df = cloud(spark, [(1, 2, 0.2), (1.8, 2.6, 1.0)], track_id=7)
    records = layout.object_records(df, "track_id", F.lit("chair"))
    row = records.first()
    assert row.id == "chair_7" and row.size_x == pytest.approx(0.8)
    assert '"count":0' in layout.object_map(records.limit(0)).first().value


def test_packing_colors_and_names(spark):
    df = spark.createDataFrame([("_A b!_", 300)], "n string, i int")
    row = df.select(
        detection.safe_name(F.col("n"), key=True).alias("key"), color.pack_rgb(F.lit(1), F.lit(2), F.lit(3)).alias("rgb"),
        geometry.packed_key(F.lit(1), F.lit(-1), F.lit(0)).alias("packed"), geometry.packed_key(F.lit(1 << 20), F.lit(0), F.lit(0)).alias("lost"),
    ).first()
    assert (row.key, row.rgb, row.lost) == ("a_b", 0x010203, None) and row.packed is not None


def test_similarity_rules(spark):
    df = spark.sql("select map(56, 3.0D, 57, 1.0D) as s")
    of = lambda c, n, s=F.col("s"): detection.similarity(F.lit(c), F.lit(n), F.lit(56), F.lit("chair"), s)
    row = df.select(of(57, "x").alias("a"), of(-1, "chair").alias("b"), of(56, "x", F.expr("map(56, 0.0D)")).alias("c")).first()
    assert tuple(row) == (0.25, 1.0, 1.0)


def test_every_box_is_projected(spark):
    """All valid orders' boxes against brute force over the pixels of their frames."""
    data = "/root/testdata/sf0.001"
    boxes = queries._scaled(spark, data).where("box is not null").select("o_orderkey", "box.*").toPandas()
    pixels = {f: p for f, p in queries._pixels(spark, data).where("depth between 0.3 and 5.0").toPandas().groupby("frame_id")}
    want = {}
    for b in boxes.itertuples():
        p = pixels.get(b.o_orderkey % 16)
        if p is None:
            continue
        left, top = p.u - b.left, p.v - b.top
        n = int(((left >= 0) & (p.u < b.right) & (top >= 0) & (p.v < b.bottom) & (left % 2 == 0) & (top % 2 == 0)).sum())
        if n:
            want[b.o_orderkey] = n
    got = queries.bbox_project_all(spark, data).collect()
    assert {r.detection_id: r.n for r in got} == want and len(got) == len(want)
    assert any(k % 50 for k in want)


def test_equal_boxes_are_projected_once(spark, tmp_path, monkeypatch):
    """Orders of few customers, some of a repeated key, give the rows of the SQL; each box of a frame is projected once."""
    rng = np.random.default_rng(3)
    # Keys below 32 twice or more, with boxes of their own.
    orders = pd.DataFrame({"o_orderkey": np.r_[np.arange(400), np.arange(32)], "o_custkey": rng.integers(0, 5, 432) * 97})
    items = pd.DataFrame({"l_orderkey": rng.integers(0, 64, 4000), "l_partkey": rng.integers(0, 640, 4000), "l_suppkey": rng.integers(0, 480, 4000)})
    orders.to_parquet(tmp_path / "orders.parquet")
    items.assign(l_quantity=rng.integers(1, 51, 4000) * 1.0).to_parquet(tmp_path / "lineitem.parquet")
    con, given, project = duckdb.connect(), [], projection.project_boxes
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    monkeypatch.setattr(projection, "project_boxes", lambda boxes, *more: given.append(boxes) or project(boxes, *more))
    got = queries.bbox_project_all(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["bbox_project_all"]).fetchall()) and len(got) > 200
    boxes = given[0].toPandas()
    assert len(boxes) == len(boxes.drop_duplicates()) <= 5 * 16


def test_a_box_is_computed_once_a_row(spark):
    """Filters on a box and its corners do not repeat the expression, which would be too long to compile."""
    found = queries._scaled(spark, "/root/testdata/sf0.001").where("box is not null and box.left < box.right").select("box.*")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FLOOR") <= 4


def test_whole_masks_erode_and_resize(spark, tmp_path):
    """Masks of 640 x 480 in several frames, as pixels of ``lineitem``, against numpy."""
    rng = np.random.default_rng(2)
    masks = np.zeros((3, 480, 640), bool)
    for m in masks:
        for _ in range(6):
            u, v = rng.integers(0, 600), rng.integers(0, 440)
            m[v : v + rng.integers(2, 90), u : u + rng.integers(2, 90)] = True
    masks[0, :20, :20] = True
    frame, v, u = np.nonzero(masks)
    back = np.argsort(np.arange(480) * 37 % 480)  # l_suppkey * 37 % 480 = v
    pd.DataFrame({"l_orderkey": frame, "l_partkey": u, "l_suppkey": back[v], "l_quantity": 10.0}).to_parquet(tmp_path / "lineitem.parquet")
    edge = np.pad(masks, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    whole = np.all([edge[:, 1 + j : 481 + j, 1 + i : 641 + i] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    small = masks[:, np.arange(336) * 480 // 336][:, :, np.arange(448) * 640 // 448]
    for name, want in ("mask_erode_all", whole), ("mask_resize_all", small):
        got = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert sorted(zip(got.frame_id, got.v, got.u, strict=True)) == list(zip(*np.nonzero(want), strict=True))
