"""Connected components by minimum-label stars with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import materialize

ROUNDS = 60


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; component is its smallest node.

    Alternates large-star and small-star contraction: each round attaches the
    neighbourhood of a node to its minimum, so long chains shrink geometrically and a
    hub only ever aggregates a minimum (partial aggregation keeps hubs cheap).
    Self loops and nulls are ignored; an empty input gives an empty result.
    """
    pairs = (
        edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    current = materialize(pairs, "edges")
    before = None
    for _ in range(ROUNDS):
        current = materialize(_small_star(_large_star(current)), "star")
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not converge")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the minimum of its neighbourhood."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours attach to the smallest of them."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
