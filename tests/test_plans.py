import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelar.plans import cut, groups, session
from voxelar.operators import projection, rounds, spatial
from voxelar.plans.components import connected_components


def roots(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "none"])
def test_components(spark, kind):
    rng = random.Random(kind)
    pairs = {
        "random": [tuple(rng.sample(range(-150, 150), 2)) for _ in range(140)],
        "chain": [(i, i + 1) for i in range(200)],
        "hub": [(500, i) for i in range(300)],
        "none": [],
    }[kind]
    df = spark.createDataFrame([*pairs, (7, 7), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == roots(pairs)


def test_groups_are_never_cut(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.range(500).select((F.col("id") % 13).alias("g"), (F.col("id") % 2).alias("h"), "id")
    got = groups.map_whole_groups(df, ["g", "h"], lambda p: p.groupby(["g", "h"], as_index=False).id.count(), "g long, h long, id long").toPandas()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = df.toPandas().groupby(["g", "h"], as_index=False).id.count()
    pd.testing.assert_frame_equal(got.sort_values(["g", "h"], ignore_index=True), want.astype("int64"))


def test_materialized_rows_and_size_checks(spark):
    df = spark.range(10).select("id", F.lit(None).cast("string").alias("n"))
    again = cut.materialize(df)
    assert again.dtypes == df.dtypes and again.count() == 10
    assert "broadcast" in cut.broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert cut.broadcast_if_small(df, 9) is df


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    key = cut.SHUFFLE_CLEANUP
    set_before, before = spark.conf.get(key, None), shuffle_files(spark)
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count()
    again = cut.materialize(grouped.join(grouped.withColumnRenamed("count", "n").hint("merge"), "g"))
    for _ in range(50):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left and again.count() == 7 and spark.conf.get(key, None) == set_before


@pytest.mark.parametrize("width", [1, 2, spatial.WIDE])
def test_hits_do_not_depend_on_the_width_of_cells(spark, width):
    rng = random.Random(4)
    place = lambda: rng.choices([rng.uniform(-0.7, 0.7), rng.randrange(-4, 5) * 0.15, float("nan"), None], [20, 40, 1, 1])[0]
    a, b = ([(i, rng.randrange(2), *(place() for _ in "xyz")) for i in range(n)] for n in (150, 220))
    left, right = (spark.createDataFrame(t, "id long, g long, x double, y double, z double") for t in (a, b))
    bare = lambda p: None in p or any(math.isnan(v) for v in p)
    near = lambda p, q: not bare(p[2:] + q[2:]) and p[1] == q[1] and sum((u - v) ** 2 for u, v in zip(p[2:], q[2:], strict=True)) <= 0.15 * 0.15
    want = sorted(p[0] for p in a if any(near(p, q) for q in b))
    assert sorted(r.id for r in spatial.radius_hits(left, right, 0.15, ["g"], width).collect()) == want and 10 < len(want) < 150


def test_clouds_meet_on_few_copies(spark):
    """A point is copied to the cells its ball reaches: eight at most where cells are wide, 27 before."""
    p = spark.range(3000).select("id", *[((F.rand(k) - 0.5) * 4).alias(a) for k, a in enumerate("xyz")])
    copies = spatial.reached(p, 0.15, 0.15 * spatial.WIDE).groupBy("id").count().agg(F.avg("count"), F.max("count")).first()
    assert copies[0] < 3.7 and copies[1] <= 8


def test_points_of_a_pair_are_dealt_by_the_pair(spark):
    """The copies of points in cells are not shuffled; where that is not asked for the rows are the same."""
    key = ["session", "place", "track"]
    cloud = lambda name, seed: spark.range(400).select(F.lit("s").alias("session"), (F.col("id") % 5).alias(name), *[F.rand(seed + k).alias(a) for k, a in enumerate("xyz")])
    left, right = cut.materialize(cloud("place", 1)), cut.materialize(cloud("track", 4))
    pairs = cut.materialize(spark.range(25).select(F.lit("s").alias("session"), (F.col("id") % 5).alias("place"), F.expr("id div 5").alias("track")))
    again = rounds.cloud_shares(pairs, left, right, 0.1, key).collect()
    with session.settings(spark, {cut.DEAL_AGAIN: "false"}):
        shares = rounds.cloud_shares(pairs, left, right, 0.1, key)
        assert sorted(shares.collect()) == sorted(again) and 0 < again[0].overlap < 1
    dealt = [line for line in shares._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("kx" in line for line in dealt)
    assert sorted(cut.materialize(shares, together=True).collect()) == sorted(again)


def test_small_groups_cluster_as_others(spark):
    """Sparse, dense and repeated points, groups of fewer and more points than neighbours are looked at."""
    rng = random.Random(5)
    rows = []
    for g, (n, wide) in enumerate([(40, 0.12), (150, 0.2), (300, 0.1), (25, 0.08), (60, 0.02)]):
        rows += [(g, *(round(rng.gauss(0, wide), 2) for _ in "xyz")) for _ in range(n)]
    df = cut.materialize(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, g long, x double, y double, z double"))
    a, b = (sorted(map(tuple, spatial.largest_cluster(df, 0.12, 4, "ord", ["g"], small=s).collect())) for s in (False, True))
    assert a == b and len(a) == len(rows) and {kept for *_, kept in a} == {True, False}


def test_batch_size_is_lowered_from_the_default_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    session.small_batches(spark)
    assert spark.conf.get(key) == str(session.BATCH_ROWS)
    spark.conf.set(key, "99")
    assert session.small_batches(spark).conf.get(key) == "99"
    spark.conf.unset(key)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_dealt_to_tiles_are_not_broadcast(spark):
    boxes = spark.range(50).selectExpr("0L as frame_id", "id as detection_id", "0 as left", "0 as top", "640 as right", "480 as bottom")
    pixels = spark.range(50).selectExpr("0L as frame_id", "cast(id as int) as u", "cast(id as int) as v", "1.0D as depth")
    found = projection.project_boxes(boxes, pixels, {"fx": 1.0, "fy": 1.0, "cx": 0.0, "cy": 0.0})
    assert "Broadcast" not in physical(found)
    assert found.count() == 50 * 25


def test_copies_in_neighbour_cells_are_not_broadcast(spark):
    p = spark.range(40).selectExpr("id", "id % 2 as part", "id / 100D as x", "0D as y", "0D as z")
    plans = [spatial.radius_pairs(p, p, 0.05, ["part"]), spatial.radius_hits(p, p, 0.05, ["part"]), spatial.overlap_pairs(p, 0.05, "part", "id")]
    for found in plans[:2]:
        assert "Broadcast" not in physical(found)
    assert not any("Generate" in side for side in physical(plans[2]).split("BroadcastExchange")[1:])
    assert plans[0].count() == sum(abs(a - b) / 100 <= 0.05 + 1e-12 and (a - b) % 2 == 0 for a in range(40) for b in range(40))
