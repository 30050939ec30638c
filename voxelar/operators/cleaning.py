"""Cleaning of observations before they are tracked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelar.config import MapConfig
from voxelar.functions.geometry import AXES
from voxelar.plans.cut import materialize

from .spatial import largest_cluster
from .voxels import CELLS, voxel_mean

#: Points below which an observation is dropped (a fixed value).
LEAST_POINTS = 3


def clean_observations(points: DataFrame, config: MapConfig = MapConfig(), key: Sequence[str] = ("session", "frame", "observation")) -> DataFrame:
    """``key, points``: each observation as the voxel means of its largest cluster, in order of voxel.

    ``points``: ``key, x, y, z``. Observations of fewer than three points afterwards go.
    All frames are cleaned at once; only one observation's points, bounded by its box, meet in a row.
    """
    means = voxel_mean(points, config.voxel_size, key)
    # Numbers ascend by voxel within an observation, and are stored so that they never change.
    ordered = means.repartition(*key).sortWithinPartitions(*key, *CELLS)
    numbered = materialize(ordered.select(*key, *AXES, F.monotonically_increasing_id().alias("ord")), "voxels")
    kept = largest_cluster(numbered, config.cluster_eps, config.cluster_min_points, "ord", list(key), small=True).where("kept")
    fine = numbered.join(kept.select("ord"), "ord", "left_semi")
    gathered = F.sort_array(F.collect_list(F.struct("ord", *AXES)))
    bare = F.transform(gathered, lambda p: F.struct(*[p[a].cast("float").alias(a) for a in AXES]))
    return fine.groupBy(*key).agg(bare.alias("points")).where(F.size("points") >= LEAST_POINTS)
