"""Grid-keyed spatial joins: radius overlap, bounded neighbours, clusters, box pairs.

Neighbours within a radius lie in the 27 cells around a point's cell. One side is
copied to those cells and joined on equal cells, so the join is a hash join on keys
that spread the points; the distance is a residual filter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelar.functions.geometry import AXES, bounds_near, box_overlap, voxel_key
from voxelar.plans.components import connected_components
from voxelar.plans.cut import dealt, materialize

from .voxels import CELLS, with_cells

#: Neighbours a clustering looks at, and the size below which a cluster is not trusted (fixed values).
NEIGHBOURS = 32
LEAST_CLUSTER = 5
#: Radii a cell is wide where single clouds meet, which are thinned to a point a voxel.
WIDE = 4
#: Balls in which ``close_pairs`` counts, each of half the volume of the one before.
HALVINGS = 18
#: Radii, each half of the one before, at which ``by_reach`` looks.
REACHES = 6


def cloud_bounds(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Centroid, corners and number of points per group."""
    aggs = [f(F.col(a).cast("double")).alias(f"{p}_{a}") for p, f in (("c", F.avg), ("lo", F.min), ("hi", F.max)) for a in AXES]
    return points.groupBy(*by).agg(*aggs, F.count("*").alias("n"))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def around(points: DataFrame) -> DataFrame:
    """Every point once in each of the 27 cells around its own.

    Spark takes the copies for as small as the points, so a join would broadcast them: they are merged instead.
    """
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    for k in CELLS:
        points = points.withColumn("_d", F.explode(steps)).withColumn(k, F.col(k) + F.col("_d")).drop("_d")
    return points.hint("merge")


def squared(a: str, b: str) -> Column:
    d = [F.col(f"{a}{x}").cast("double") - F.col(f"{b}{x}").cast("double") for x in AXES]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def radius_pairs(
    left: DataFrame, right: DataFrame, radius: float, by: Sequence[str] = (), strict: bool = False, width: int = 1
) -> DataFrame:
    """Pairs of ``left`` and ``right`` points within ``radius``, columns prefixed ``a_``/``b_``, with ``d2``.

    ``by`` columns must be equal. The right side is the one copied to neighbour cells, ``width`` as in ``radius_hits``.
    """
    keys = [*by, *CELLS]
    a = prefixed(with_cells(left, radius * width), "a_", keys)
    b = prefixed(reached(right, radius, radius * width), "b_", keys) if width > 1 else around(prefixed(with_cells(right, radius), "b_", keys))
    near = F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius
    return a.join(b, keys).withColumn("d2", squared("a_", "b_")).where(near)


def reached(points: DataFrame, radius: float, side: float) -> DataFrame:
    """Every point once in each cell of ``side`` that its ball reaches, merged as ``around``."""
    reach = radius * (1 + 2**-30)  # distances are rounded
    for k, a in zip(CELLS, AXES, strict=True):
        ends = [voxel_key(F.col(a).cast("double") + d, side) for d in (-reach, reach)]
        points = points.withColumn(k, F.explode(F.sequence(*ends)))
    return points.hint("merge")


def radius_hits(left: DataFrame, right: DataFrame, radius: float, by: Sequence[str] = (), width: int = 1) -> DataFrame:
    """Points of ``left`` that have a point of ``right`` within ``radius`` where ``by`` is equal; a search ends at the first.

    Cells are ``width`` radii wide: of a point of ``right`` there are (1 + 2 / width)^3 copies, 27 or, at ``WIDE``, 3.4;
    a point of ``left`` meets all of its cell.
    """
    keys = [*by, *CELLS]
    a = with_cells(left, radius * width)
    b = reached(right, radius, radius * width).select(*keys, *[F.col(x).alias(f"b_{x}") for x in AXES])
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[f"b_{x}" for x in AXES])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    near = squared("", "b_") <= radius * radius
    return a.join(b, [*same, near], "left_semi").drop(*CELLS)


def overlap_pairs(points: DataFrame, radius: float, label: str, order: str) -> DataFrame:
    """Ordered label pairs ``(a, b)`` with the share of a's points that have a point of b within ``radius``."""
    pts = points.select(label, order, *AXES)
    cells = around(with_cells(pts, radius).select(F.col(label).alias("b"), *CELLS).distinct()).distinct()
    # A point meets every label with a cell beside it once, whatever number of points is there.
    asked = with_cells(pts.withColumnRenamed(label, "a"), radius).join(cells, list(CELLS)).where("a <> b").drop(*CELLS)
    hits = radius_hits(asked, pts.withColumnRenamed(label, "b"), radius, ["b"])
    counts = hits.groupBy("a", "b").agg(F.count("*").alias("hits"))
    sizes = pts.groupBy(F.col(label).alias("a")).agg(F.count("*").alias("n"))
    return counts.join(sizes, "a").select("a", "b", "hits", "n", (F.col("hits") / F.col("n")).alias("share"))


def cloud_overlap(points: DataFrame, radius: float, label: str, order: str) -> DataFrame:
    """Unordered pairs that touch at all: the larger of the two directional shares."""
    shares = overlap_pairs(points, radius, label, order)
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return shares.groupBy(low, high).agg(F.max("share").alias("overlap"))


def by_reach(points: DataFrame, eps: float, k: int, by: Sequence[str] = (), small: bool = False) -> list[tuple[float, DataFrame]]:
    """``(radius, points)``: each point once, at ``eps`` or at a smaller radius that is sure to hold ``k`` points around it.

    Cells are so small that the 27 around a point lie within half the radius; where they hold ``k`` points, that half
    is tried in turn. ``points`` have ``_copy``, the place among equal points, of which ``k`` count. ``small`` groups
    stay in a task each, and those of fewer than ``k`` points are not asked.
    """
    keys, found, radius = [*by, *CELLS], [], eps
    for _ in range(REACHES):
        side = radius / 2 / math.sqrt(12) * (1 - 2**-10)
        told_apart = F.greatest(*[F.abs(a) for a in AXES]) < side * 2.0**40  # beyond, cells are as coarse as the numbers
        cells = with_cells(points, side)
        asked = dealt(cells, by).withColumn("_size", F.count("*").over(W.partitionBy(*by))).where(F.col("_size") >= k) if small else cells
        held = asked.where((F.col("_copy") <= k) & told_apart).groupBy(*keys).agg(F.count("*").alias("_n"))
        full = materialize(around(held).groupBy(*keys).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k), "full")
        if full.isEmpty():
            break
        near = cells.join(full.hint("merge"), keys, "left").withColumn("_full", F.col("_n").isNotNull() & told_apart)
        near = materialize(near.select(*points.columns, "_full"), "reach")
        found.append((radius, near.where("not coalesce(_full, false)").drop("_full")))
        points, radius = near.where("_full").drop("_full"), radius / 2
    return [*found, (radius, points)]


def _reached_pairs(points: DataFrame, eps: float, k: int, order: str, by: Sequence[str], least: int, small: bool = False) -> list[DataFrame]:
    """``close_pairs`` by radius, with ``a_core`` and ``b_core``: points with ``least`` others (``k`` at most) within ``eps``."""
    copy = F.row_number().over(W.partitionBy(*by, *AXES).orderBy(order))
    pts = materialize(points.select(*by, order, *AXES).withColumn("_copy", copy), "points")
    others = pts.where(F.col("_copy") <= k).drop("_copy")
    bounded, found, width = [], by_reach(pts, eps, k, by, small), WIDE if small else 1
    for radius, some in found:
        balls = {f"_n{i}": radius * radius * 2 ** (-2 * i / 3) for i in range(HALVINGS, -1, -1)}
        counts = radius_pairs(some, others, radius, by, True, width).groupBy(*by, F.col(f"a_{order}").alias(order)).agg(*[F.count_if(F.col("d2") < d2).alias(n) for n, d2 in balls.items()])
        enough = F.coalesce(*[F.when(F.col(n) >= k, F.lit(d2)) for n, d2 in balls.items()], F.lit(radius * radius))
        told = counts.select(*by, order, enough.alias("_bound"), (F.col("_n0") >= least).alias("_core"), F.lit(radius).alias("_radius"))
        bounded.append(some.join(told, [*by, order]))
    bounded = materialize(functools.reduce(DataFrame.unionByName, bounded), "bounds")
    others = bounded.where(F.col("_copy") <= k).select(*by, order, *AXES, "_core")
    pairs = [radius_pairs(bounded.where(F.col("_radius") == radius), others, radius, by, True, width).where("d2 < a__bound") for radius, _ in found]
    names = {f"a_{order}": "a", f"b_{order}": "b", "d2": "d2", "a__core": "a_core", "b__core": "b_core"}
    return [p.select(*by, *[F.col(c).alias(n) for c, n in names.items()]) for p in pairs]


def close_pairs(points: DataFrame, eps: float, k: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, a, b, d2``: pairs within ``eps`` in the same group, about twice ``k`` for a point, its ``k`` nearest among them.

    A point is compared within a radius that holds ``k`` points (``by_reach``). Its pairs are first only counted in
    balls of falling volume; the smallest ball with ``k`` of them bounds its pairs. Of equal points only the first ``k``
    can be among anyone's nearest.
    """
    pairs = _reached_pairs(points, eps, k, order, by, 1)
    return functools.reduce(DataFrame.unionByName, pairs).drop("a_core", "b_core")


def _nearest(points: DataFrame, eps: float, k: int, order: str, by: Sequence[str], least: int = 1, small: bool = False) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by, "a").orderBy("d2", "b"))
    # Ranked before the union: a task would hold the joins of all radii.
    ranked = [p.withColumn("rank", rank).where(F.col("rank") <= k) for p in _reached_pairs(points, eps, k, order, by, least, small)]
    return functools.reduce(DataFrame.unionByName, ranked)


def bounded_knn(points: DataFrame, eps: float, k: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Up to ``k`` nearest points within ``eps`` in the same group, the point itself included.

    Columns ``by, a, b, d2, rank``; ties by ``order``.
    """
    return _nearest(points, eps, k, order, by).drop("a_core", "b_core")


def largest_cluster(
    points: DataFrame, eps: float, least: int, order: str, by: Sequence[str], neighbours: int = NEIGHBOURS, small: bool = False
) -> DataFrame:
    """``by, order, kept``: which points belong to their group's largest density cluster.

    Points with ``least`` bounded neighbours are cores; linked cores form components; a
    point beside a core joins its nearest one. Ties go to the component with the
    smallest core. Where a group has too few points, no core or only a small cluster,
    all its points are kept. ``order`` must be unique over all groups. ``small``: groups are
    single clouds, thinned to a point a voxel, of which a task can hold many.
    """
    least = max(1, least)
    size = points.groupBy(*by).agg(F.count("*").alias("size"))
    if eps <= 0:
        return points.select(*by, order, F.lit(True).alias("kept"))
    near = _nearest(points, eps, max(least, neighbours), order, by, least, small).where("b_core")
    near = materialize(near.select("a", "b", "a_core", "rank", F.when(~F.col("a_core"), F.col("d2")).alias("d2")), "neighbours")
    found = connected_components(near.where("a_core"))
    cores = near.where("a_core and rank = 1").select("a")  # nearest to a core is itself, or a core at the same place
    labels = cores.join(found.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("component", "a").alias("_label"))
    border = near.where("not a_core").groupBy("a").agg(F.min_by("b", F.struct("d2", "b")).alias("core"))
    beside = border.join(labels.withColumnRenamed("a", "core"), "core").select("a", "_label")
    every = materialize(labels.unionByName(beside), "labels")
    named = points.select(*by, F.col(order).alias("a")).join(every, "a", "left")
    sizes = named.where("_label is not null").groupBy(*by, "_label").agg(F.count("*").alias("members"))
    best = sizes.groupBy(*by).agg(F.max_by(F.struct("_label", "members"), F.struct(F.col("members"), -F.col("_label"))).alias("best"))
    whole = F.col("best").isNull() | (F.col("best.members") < LEAST_CLUSTER) | (F.col("size") < least)
    joined = named.join(size, list(by)).join(best, list(by), "left")
    return joined.select(*by, F.col("a").alias(order), (whole | F.coalesce(F.col("_label") == F.col("best._label"), F.lit(False))).alias("kept"))


def facing_boxes(left: DataFrame, right: DataFrame, margin: float, reach: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of a left and a right group whose centroids lie within ``reach`` and whose boxes come within ``margin``.

    Both as from ``cloud_bounds``, columns prefixed ``a_``/``b_``. Joined on centroid cells of size ``reach``.
    """
    size = {k: F.floor(F.col(f"c_{a}") / reach).cast("long") for k, a in zip(CELLS, AXES, strict=True)}
    keys = [*by, *CELLS]
    joined = prefixed(left.withColumns(size), "a_", keys).join(around(prefixed(right.withColumns(size), "b_", keys)), keys)
    d = [F.col(f"a_c_{x}") - F.col(f"b_c_{x}") for x in AXES]
    distance = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    near = joined.withColumn("distance", distance).where((F.col("distance") <= reach) & bounds_near("a_", "b_", margin))
    return near.withColumn("box_overlap", box_overlap("a_", "b_"))


def box_pairs(bounds: DataFrame, label: str, margin: float, reach: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of groups of one table, each once: ``facing_boxes`` of ``bounds`` with itself."""
    return facing_boxes(bounds, bounds, margin, reach, by).where(F.col(f"a_{label}") < F.col(f"b_{label}"))


def even_subsample(points: DataFrame, limit: int, order: str, by: Sequence[str]) -> DataFrame:
    """At most ``limit`` points per group, evenly spaced in stored order (index i (n - 1) / (limit - 1), cut)."""
    position = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    total = F.count("*").over(W.partitionBy(*by))
    # p is chosen if some i has floor(i * step) = p; only the whole numbers around p / step can.
    ranked = points.withColumns({"_p": position, "_n": total})
    step = (F.col("_n") - 1) / F.lit(max(1, limit - 1)).cast("double")
    chosen = F.col("_n") <= limit
    for k in (-1, 0, 1, 2):
        i = F.floor(F.try_divide(F.col("_p"), step)) + k
        chosen = chosen | ((i >= 0) & (i < limit) & (F.floor(i * step) == F.col("_p")))
    return ranked.where(chosen).drop("_p", "_n")
