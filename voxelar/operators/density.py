"""Density clusters by a graph of grid cells.

Two points of a cell of side eps / sqrt 3 are always neighbours, so a cell with enough
points is all core and hangs together without listing a pair. Only points of sparse
cells count neighbours, and only cells are linked: each has one node, however dense.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelar.functions.geometry import AXES
from voxelar.plans.components import connected_components
from voxelar.plans.cut import materialize

from .spatial import squared
from .voxels import CELLS, with_cells

#: A cell's side is a little below eps / sqrt 3, so that rounding cannot part its corners by eps.
SLACK = 1e-9
REACH = 2


def _beside(cells: DataFrame, prefix: str = "n") -> DataFrame:
    """Each row once for each of the cells that may hold a neighbour, its own included; merged, as in ``around``."""
    steps = F.array(*[F.lit(i) for i in range(-REACH, REACH + 1)])
    for k in CELLS:
        cells = cells.withColumn("_d", F.explode(steps)).withColumn(f"{prefix}{k}", F.col(k) + F.col("_d")).drop("_d")
    return cells.hint("merge")


def density_clusters(points: DataFrame, eps: float, least: int, order: str, by: Sequence[str] = (), closed: bool = False) -> DataFrame:
    """``by, order, core, cluster``: exact density clusters, the smallest core ``order`` of each as its name.

    A core has ``least`` points nearer than ``eps`` in its group, itself included; cores
    nearer than that hang together; another point joins its nearest core (ties by
    ``order``) or has a null cluster. ``order`` must be unique over all groups. No join lists
    the pairs of a dense cell: points of sparse cells (fewer than ``least``) meet those of
    cells around them, and cells are linked through the points of each that lie
    nearest the other, by a semi-join where those do not decide. ``closed`` takes points
    at ``eps`` for neighbours too. Coordinates must be finite.
    """
    limit = math.nextafter(eps * eps, math.inf) if closed else eps * eps
    key = [*by, *CELLS]
    side = eps / math.sqrt(3) * (1 - SLACK)
    pts = materialize(with_cells(points.select(*by, order, *AXES), side), "points")
    cells = materialize(pts.groupBy(*key).agg(F.count("*").alias("n")), "cells")
    near = F.col("d2") < limit

    sparse = pts.join(cells.where(F.col("n") < least).select(*key), key)
    # Only cells that are there: an equi-join of cells, then of the points of both.
    pairs = _beside(cells.where(F.col("n") < least).select(*key)).join(cells.select(*by, *[F.col(k).alias(f"n{k}") for k in CELLS]), [*by, *[f"n{k}" for k in CELLS]])
    pairs = materialize(pairs, "pairs")
    others = pts.select(*by, *[F.col(k).alias(f"n{k}") for k in CELLS], F.col(order).alias("_b"), *[F.col(a).alias(f"b_{a}") for a in AXES])

    def met(own: DataFrame, other: DataFrame) -> DataFrame:
        """Points of sparse cells with the points of ``other`` nearer than eps."""
        joined = own.join(pairs, key).join(other, [*by, *[f"n{k}" for k in CELLS]])
        return joined.withColumn("d2", squared("", "b_")).where(near)

    counts = met(sparse, others).groupBy(order).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(order)
    dense = pts.join(cells.where(F.col("n") >= least).select(*key), key)
    cores = materialize(dense.unionByName(sparse.join(counts, order)), "cores")

    nodes = cores.groupBy(*key).agg(F.min(order).alias("node"), *[f(F.col(a)).alias(f"{p}_{a}") for a in AXES for p, f in (("lo", F.min), ("hi", F.max))])
    nodes = materialize(nodes, "nodes")
    links = materialize(_links(cores, nodes, limit, order, by), "links")
    found = connected_components(links)
    named = nodes.join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("cluster"))
    in_core = cores.join(named, key).select(*by, order, F.lit(True).alias("core"), "cluster")

    lone = sparse.join(counts, order, "left_anti")
    around = cores.join(named, key).select(*by, *[F.col(k).alias(f"n{k}") for k in CELLS], F.col(order).alias("_b"), "cluster", *[F.col(a).alias(f"b_{a}") for a in AXES])
    best = met(lone, around).groupBy(order).agg(F.min_by("cluster", F.struct("d2", "_b")).alias("cluster"))
    border = lone.join(best, order, "left").select(*by, order, F.lit(False).alias("core"), "cluster")
    return in_core.unionByName(border)


def _links(cores: DataFrame, nodes: DataFrame, limit: float, order: str, by: Sequence[str]) -> DataFrame:
    """``a, b``: nodes of cells with cores whose squared distance is below ``limit``."""
    key = [*by, *CELLS]
    box = [f"{p}_{a}" for p in ("lo", "hi") for a in AXES]
    other = nodes.select(*by, *[F.col(k).alias(f"n{k}") for k in CELLS], F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in box])
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo_{a}") - F.col(f"hi_{a}"), F.col(f"lo_{a}") - F.col(f"b_hi_{a}")), 2) for a in AXES), F.lit(0.0))
    pairs = _beside(nodes.withColumnRenamed("node", "a")).join(other, [*by, *[f"n{k}" for k in CELLS]]).where("a < b").where(gap < limit)
    pairs = materialize(pairs, "cell-pairs")

    def nearest(to: str, at: Sequence[str], name: str) -> DataFrame:
        """Of each pair's one cell the core nearest the middle of the other's box."""
        where_ = [F.col(c).alias(k) for c, k in zip(at, CELLS, strict=True)]
        middle = [((F.col(f"{to}lo_{x}") + F.col(f"{to}hi_{x}")) / 2).alias(f"m_{x}") for x in AXES]
        asked = pairs.select(*by, "a", "b", *where_, *middle).join(cores.select(*key, order, *AXES), key)
        return asked.groupBy("a", "b").agg(F.min_by(F.struct(*AXES), F.struct(squared("", "m_"), F.col(order))).alias(name))

    sides = nearest("b_", CELLS, "p").join(nearest("", [f"n{k}" for k in CELLS], "q"), ["a", "b"])
    d2 = sum((F.pow(F.col(f"p.{x}") - F.col(f"q.{x}"), 2) for x in AXES), F.lit(0.0))
    sides = materialize(sides.select("a", "b", (d2 < limit).alias("linked")), "sides")
    open_ = pairs.join(sides.where("not linked").select("a", "b"), ["a", "b"])

    def beside(cell: Sequence[str], to: str) -> DataFrame:
        """Cores of one side of the undecided pairs that are near the other side's box."""
        where_ = [F.col(c).alias(k) for c, k in zip(cell, CELLS, strict=True)]
        off = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"{to}lo_{x}") - F.col(x), F.col(x) - F.col(f"{to}hi_{x}")), 2) for x in AXES), F.lit(0.0))
        asked = open_.select(*by, "a", "b", *where_, *[f"{to}{c}" for c in box]).join(cores.select(*key, *AXES), key)
        return asked.where(off < limit).select("a", "b", *AXES)

    left = beside(CELLS, "b_")
    right = beside([f"n{k}" for k in CELLS], "").select(F.col("a").alias("_a"), F.col("b").alias("_b"), *[F.col(x).alias(f"b_{x}") for x in AXES])
    hits = left.join(right, [F.col("a") == F.col("_a"), F.col("b") == F.col("_b"), squared("", "b_") < limit], "left_semi")
    return sides.where("linked").select("a", "b").unionByName(hits.select("a", "b").distinct())


def largest_density_cluster(points: DataFrame, eps: float, least: int, order: str, by: Sequence[str], smallest: int = 5) -> DataFrame:
    """``by, order, kept``: the points of each group's largest density cluster (ties: the smallest name).

    A group of fewer than ``least`` points, without a cluster, or with none of ``smallest`` points keeps all.
    """
    found = materialize(density_clusters(points, eps, max(1, least), order, by), "clusters")
    size = found.groupBy(*by).agg(F.count("*").alias("size"))
    members = found.where("cluster is not null").groupBy(*by, "cluster").agg(F.count("*").alias("members"))
    best = members.groupBy(*by).agg(F.max_by(F.struct("cluster", "members"), F.struct("members", -F.col("cluster"))).alias("best"))
    whole = F.col("best").isNull() | (F.col("best.members") < smallest) | (F.col("size") < least)
    joined = found.join(size, list(by)).join(best, list(by), "left")
    return joined.select(*by, order, (whole | F.coalesce(F.col("cluster") == F.col("best.cluster"), F.lit(False))).alias("kept"))
