"""Voxel grids: means, representatives, merges and folds of point clouds.

Points are rows ``x, y, z`` with grouping columns; a voxel is its group plus three
cells, so every operator is one hash aggregation or equi-join on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelar.functions.geometry import AXES, packed_key, voxel_key

CELLS = ("kx", "ky", "kz")
CHANNELS = ("r", "g", "b")


def with_cells(points: DataFrame, size: float, narrow: bool = False) -> DataFrame:
    return points.withColumns({k: voxel_key(F.col(a), size, narrow) for k, a in zip(CELLS, AXES, strict=True)})


def mean_channel(name: str) -> Column:
    """Mean colour, ties to even, kept within a byte."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.avg(name)).cast("int"))).alias(name)


def voxel_mean(points: DataFrame, size: float, by: Sequence[str] = (), colors: bool = False, narrow: bool = False) -> DataFrame:
    """Mean point (and colour) of every occupied voxel with its number of points."""
    cells = with_cells(points, size, narrow).groupBy(*by, *CELLS)
    means = [F.avg(F.col(a).cast("double")).alias(a) for a in AXES]
    return cells.agg(*means, *[mean_channel(c) for c in CHANNELS if colors], F.count("*").alias("n"))


def voxel_first(points: DataFrame, size: float, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The first point of every voxel by ``order``; a size that is not positive keeps all points."""
    if size <= 0:
        return points
    rest = [c for c in points.columns if c not in by]
    first = with_cells(points, size).groupBy(*by, *CELLS).agg(F.min_by(F.struct(*rest), F.col(order)).alias("p"))
    return first.select(*by, *[F.col(f"p.{c}").alias(c) for c in rest])


def merge_clouds(first: DataFrame, second: DataFrame, size: float, by: Sequence[str] = (), colors: bool = False) -> DataFrame:
    """Two voxelised clouds merged: a shared voxel gets the midpoint of its two points, whatever their counts."""
    key = [*by, *CELLS]
    value = [*AXES, *(CHANNELS if colors else ())]
    a = with_cells(first, size).select(*key, *[F.col(c).alias(f"a_{c}") for c in value])
    b = with_cells(second, size).select(*key, *[F.col(c).alias(f"b_{c}") for c in value])

    def merged(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        middle = (x.cast("double") + y.cast("double")) * 0.5
        if c in CHANNELS:
            middle = F.rint(middle).cast("int")
        return F.coalesce(middle, x, y).alias(c)

    both = (F.col("a_x").isNotNull() & F.col("b_x").isNotNull()).alias("shared")
    return a.join(b, key, "full_outer").select(*key, *[merged(c) for c in value], both)


def fold_clouds(points: DataFrame, size: float, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Per voxel the points of successive frames folded in order, each step the midpoint.

    Midpoint after midpoint is a sum with weights 1/2, 1/4, ... from the last frame back, where
    the first has the weight of the second: no voxel's history is gathered in one row.
    """
    first = with_cells(points, size).groupBy(*by, *CELLS, order).agg(*[F.avg(F.col(a).cast("double")).alias(a) for a in AXES])
    back = W.partitionBy(*by, *CELLS).orderBy(F.desc(order))
    ranked = first.withColumns({"_age": F.row_number().over(back), "_first": F.lead(order).over(back).isNull()})
    weight = F.pow(F.lit(0.5), F.col("_age") - F.col("_first").cast("int"))
    sums = [F.sum(F.col(a) * weight).alias(a) for a in AXES]
    return ranked.groupBy(*by, *CELLS).agg(*sums, F.count("*").alias("frames"))


def shared_cells(points: DataFrame, size: float, label: str) -> DataFrame:
    """For labels that share voxels: the shared part of either cell set, whichever is larger."""
    cells = with_cells(points, size).select(label, *CELLS).distinct()
    sizes = cells.groupBy(label).agg(F.count("*").alias("n"))
    a, b = cells.withColumnRenamed(label, "a"), cells.withColumnRenamed(label, "b")
    hits = a.join(b, list(CELLS)).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    with_a = hits.join(sizes.select(F.col(label).alias("a"), F.col("n").alias("n_a")), "a")
    both = with_a.join(sizes.select(F.col(label).alias("b"), F.col("n").alias("n_b")), "b")
    ratio = F.greatest(F.col("shared") / F.col("n_a"), F.col("shared") / F.col("n_b"))
    return both.select("a", "b", "shared", ratio.alias("overlap"))


def store_voxels(points: DataFrame, size: float, table: str, buckets: int = 8, path: str | None = None) -> None:
    """Mean points of voxels as a table bucketed and sorted by the packed cell code, for merges that move no rows.

    Cells beyond the 21 bits of a code (``packed_key``) go to ``{table}_far``, which is merged by cells.
    """
    coded = voxel_mean(points, size).withColumn("code", packed_key(*[F.col(k) for k in CELLS]))
    near = coded.where("code is not null").repartition(buckets, "code").write.bucketBy(buckets, "code").sortBy("code").format("parquet")
    far = coded.where("code is null").drop("code").write.format("parquet")
    for name, writer in ((table, near), (f"{table}_far", far)):
        (writer.option("path", f"{path}/{name}") if path else writer).saveAsTable(name)


def merge_stored(spark: SparkSession, first: str, second: str, size: float) -> DataFrame:
    """``merge_clouds`` of two stored tables with equal buckets: joined bucket by bucket, in order of the codes within each."""
    a, b = (spark.table(t).select("code", *[F.col(c).alias(f"{p}_{c}") for c in (*CELLS, *AXES)]) for t, p in ((first, "a"), (second, "b")))
    joined = a.join(b, "code", "full_outer")
    middle = [F.coalesce((F.col(f"a_{c}") + F.col(f"b_{c}")) * 0.5, f"a_{c}", f"b_{c}").alias(c) for c in AXES]
    shared = (F.col("a_x").isNotNull() & F.col("b_x").isNotNull()).alias("shared")
    near = joined.select("code", *[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in CELLS], *middle, shared)
    far = merge_clouds(spark.table(f"{first}_far"), spark.table(f"{second}_far"), size)
    return near.unionByName(far.select(F.lit(None).cast("long").alias("code"), *CELLS, *AXES, "shared"))
