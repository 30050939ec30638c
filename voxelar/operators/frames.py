"""Coordinate frames: transforms along the path between two frames of a tree, at a stamp."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelar.functions.geometry import inverse_pose, pose_product
from voxelar.plans.cut import materialize

from .asof import interpolated_pose

SHIFT, TURN = ("x", "y", "z"), ("qx", "qy", "qz", "qw")
#: Doublings of a path.
DOUBLINGS = 24


def ancestors(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, frame, ancestor, depth`` of every frame, itself at depth 0 included; ``links``: ``by, parent, child``.

    Known paths double in each round, so a chain takes as many rounds as its length has
    bits. A child of two parents or a cycle is an error.
    """
    links = materialize(links.select(*by, "parent", "child").distinct(), "links")
    if not links.groupBy(*by, "child").count().where("count > 1").isEmpty():
        raise ValueError("a frame has two parents")
    step = links.select(*by, F.col("child").alias("frame"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found = step
    for _ in range(DOUBLINGS):
        step = materialize(_longer(step, step, by), "paths")
        if step.isEmpty():
            frames = links.select(*by, F.col("child").alias("frame")).union(links.select(*by, "parent")).distinct()
            return found.unionByName(frames.select(*by, "frame", F.col("frame").alias("ancestor"), F.lit(0).alias("depth")))
        # Now all paths of up to twice the length; a path around a cycle is among them before they multiply.
        found = materialize(found.unionByName(_longer(found, step, by)).unionByName(step).distinct(), "ancestors")
        if not found.where("frame = ancestor").isEmpty():
            break
    raise ValueError("the frames form a cycle")


def _longer(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """Paths of ``first`` continued by those of ``second``."""
    rest = second.select(*by, F.col("frame").alias("ancestor"), F.col("ancestor").alias("_to"), F.col("depth").alias("_more"))
    joined = first.join(rest, [*by, "ancestor"])
    return joined.select(*by, "frame", F.col("_to").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))


def paths(links: DataFrame, wanted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges of the path from ``source`` to ``target``: ``by, source, target, child, up, step``.

    ``wanted``: ``by, source, target``. An edge is named by its child; ``up`` edges lead from
    the source to the common ancestor, the others down to the target. Steps are in
    the order in which poses multiply, the target's side first. Frames without a common
    ancestor, or the same frame twice, have no edges.
    """
    above = materialize(ancestors(links, by), "above")

    def sided(end: str) -> DataFrame:
        return above.select(*by, F.col("frame").alias(end), "ancestor", F.col("depth").alias(f"{end}_depth"))

    pairs = wanted.select(*by, "source", "target").distinct()
    common = pairs.join(sided("source"), [*by, "source"]).join(sided("target"), [*by, "target", "ancestor"])
    top = common.groupBy(*by, "source", "target").agg(F.min_by(F.struct("source_depth", "target_depth"), "source_depth").alias("top"))
    edges = []
    for end, up in (("target", False), ("source", True)):
        own = above.join(links.select(*by, F.col("child").alias("ancestor")).distinct(), [*by, "ancestor"])  # a root has no edge
        own = own.select(*by, F.col("frame").alias(end), F.col("ancestor").alias("child"), "depth")
        near = top.join(own, [*by, end]).where(F.col("depth") < F.col(f"top.{end}_depth"))
        step = F.col("depth") if not up else F.col("top.target_depth") + F.col("top.source_depth") - 1 - F.col("depth")
        edges.append(near.select(*by, "source", "target", "child", F.lit(up).alias("up"), step.alias("step")))
    return edges[0].unionByName(edges[1])


def lookup_transforms(
    lookups: DataFrame, transforms: DataFrame, fixed: DataFrame, tolerance_ns: int, by: Sequence[str] = ()
) -> DataFrame:
    """``lookups`` with the pose that takes coordinates of ``source`` to ``target`` at ``ns``; nulls where there is none.

    ``lookups``: ``lookup`` (unique), ``by, source, target, ns``; ``transforms``: ``by, parent, child, ns``
    and the pose of the child in its parent (``x, y, z, qx, qy, qz, qw``); ``fixed`` the same without
    ``ns``. Every moving edge is interpolated at the stamp between samples at most
    ``tolerance_ns`` away on either side; one that lacks either makes the result null, as do
    frames that are not connected. A frame to itself is the identity.
    """
    links = transforms.select(*by, "parent", "child").union(fixed.select(*by, "parent", "child"))
    path = materialize(paths(links, lookups, by), "paths")
    asked = lookups.join(path, [*by, "source", "target"]).select(F.struct("lookup", "step").alias("at"), *by, "child", "up", "ns")
    still = asked.join(fixed.select(*by, "child", *SHIFT, *TURN), [*by, "child"])
    moving = asked.join(fixed.select(*by, "child"), [*by, "child"], "left_anti")
    samples = transforms.select(*by, "child", F.col("ns").alias("pose_ns"), *SHIFT, *TURN)
    moved = interpolated_pose(moving, samples, "at", "ns", "pose_ns", SHIFT, tolerance_ns, [*by, "child"], TURN)
    # Written once: the arithmetic of an interpolation would be repeated in every term of a product.
    edges = materialize(moved.unionByName(still), "edges")
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in TURN), F.lit(0.0)))
    pose = F.struct(*SHIFT, *[(F.col(c) / length).alias(c) for c in TURN])
    turned = F.when(F.col("up"), pose).otherwise(inverse_pose(pose))
    every = edges.select("at.lookup", F.struct("at.step", turned.alias("pose"), F.col("qw").isNull().alias("lost")).alias("edge"))
    # A path is as long as the tree is deep, so its edges are few.
    chains = every.groupBy("lookup").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    identity = F.struct(*[F.lit(float(c == "qw")).alias(c) for c in (*SHIFT, *TURN)])
    whole = F.aggregate("edges", identity, lambda pose, edge: pose_product(pose, edge["pose"]))
    composed = chains.select("lookup", F.when(~F.exists("edges", lambda e: e["lost"]), whole).alias("pose"))
    joined = lookups.join(composed, "lookup", "left")
    same = F.when(F.col("source") == F.col("target"), identity)
    return joined.select(*lookups.columns, F.coalesce("pose", same).alias("_p")).select(*lookups.columns, *[F.col(f"_p.{c}") for c in (*SHIFT, *TURN)])

