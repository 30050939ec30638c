"""The tracker by rounds against the step by step one, and its parts by hand."""

import dataclasses
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelar import queries
from voxelar.config import MapConfig
from voxelar.operators import rounds
from voxelar.plans.cut import materialize
from voxelar.streaming import tracker

DATA = "/root/testdata/sf0.001"
KEY = ["session", "frame", "observation"]
SCHEMA = "session string, frame long, observation long, class_id int, class_name string, confidence double, stamp double, points array<struct<x:float,y:float,z:float>>, fuse boolean"


def same(observations, config):
    a, b = tracker.track_batch(observations, config).toPandas(), rounds.track_rounds(observations, config).toPandas()
    both = a.merge(b, on=KEY, suffixes=("", "_r"))
    assert len(a) == len(b) == len(both)
    assert (both.track_id == both.track_id_r).all() and (both.is_new == both.is_new_r).all()
    for c in rounds.DETAILS:
        assert np.allclose(both[c], both[f"{c}_r"], atol=1e-6)
    return both


def test_rounds_merge_and_age_as_steps(spark):
    found = same(materialize(queries.short_observations(spark, DATA).where("session < '3'")), queries.ROUNDS)
    assert 0 < found.is_new.sum() < len(found)


def test_rounds_denoise_replace_and_search_parts_as_steps(spark):
    rng = np.random.default_rng(5)
    rows = []
    # Session b has one frame less; an observation of two points ages tracks without a row.
    for session, f in itertools.product("ab", range(3)):
        for i in range(3):
            cloud = rng.normal((i * 0.5, 0, 0), 0.05, (14, 3)) if (i, f) != (2, 1) else rng.normal(0, 1, (2, 3))
            # Cleaned: one point a voxel, in order of voxels.
            cells = np.unique(tracker._cells(np.float32(cloud), 0.02), axis=0, return_index=True)[1]
            points = [tuple(float(x) for x in np.float32(p)) for p in cloud[cells]]
            if session == "a" or f < 2:
                rows.append((session, f * 3, i, 56 + (i + f) % 2, f"c{(i + f) % 2}", float(rng.uniform(0.3, 0.9)), float(f + 1), points, not (i == 1 and f == 1)))
    config = MapConfig(
        voxel_size=0.02, overlap_radius=0.1, association_threshold=0.1, cluster_eps=0.12, cluster_min_points=3, merge_interval=0, denoise_interval=2, association_max_points=8, max_extent_growth=9, max_missed=0
    )
    found = same(materialize(spark.createDataFrame(rows, SCHEMA)), config)
    assert len(found) == 13 and not found.is_new.all()


def test_no_observations(spark):
    found = rounds.track_rounds(spark.createDataFrame([], SCHEMA), MapConfig())
    assert found.count() == 0 and found.columns == [*KEY, "track_id", *rounds.DETAILS, "is_new"]


def test_larger_share_of_either_cloud(spark):
    pairs = spark.createDataFrame([("s", 1, 7), ("s", 1, 8)], "session string, place long, track long")
    left = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0), ("s", 1, 1.0, 0.0, 0.0), ("s", 1, 2.0, 0.0, 0.0)], "session string, place long, x double, y double, z double")
    right = spark.createDataFrame([("s", 7, 0.0, 0.05, 0.0), ("s", 8, 9.0, 0.0, 0.0)], "session string, track long, x double, y double, z double")
    got = {r.track: r.overlap for r in rounds.cloud_shares(pairs, left, right, 0.1, ["session", "place", "track"]).collect()}
    assert got == {7: pytest.approx(1.0), 8: 0.0}


def test_class_with_most_evidence_first_of_equals(spark):
    one = spark.range(1).select(F.expr("map(5, 1.0D, 3, 1.5D)").alias("a"), F.expr("map(9, 1.5D, 5, 0.5D)").alias("b"))
    added = rounds._added(F.col("a"), F.col("b"))
    row = one.select(F.map_keys(added).alias("keys"), F.map_values(added).alias("values")).first()
    assert row["keys"] == [5, 3, 9] and row["values"] == [1.5, 1.5, 1.5]


def test_parameters_of_the_query_merge():
    assert queries.ROUNDS.merge_interval == 2 and dataclasses.replace(queries.ROUNDS, merge_interval=10, max_missed=30) == queries.TRACKING
