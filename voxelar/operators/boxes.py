"""Detections: non-maximum suppression, best classes, optimal assignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelar.plans.cut import materialize
from voxelar.plans.groups import map_whole_groups

INFEASIBLE = 1e6


def kept_boxes(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Greedy suppression of boxes in score order: a box goes if it overlaps a kept one by more than the threshold."""
    keep = np.ones(len(boxes), bool)
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    for i in range(len(boxes)):
        if not keep[i]:
            continue
        rest = boxes[i + 1 :]
        shared = np.clip(np.minimum(boxes[i, 2:], rest[:, 2:]) - np.maximum(boxes[i, :2], rest[:, :2]), 0, None).prod(axis=1)
        union = area[i] + area[i + 1 :] - shared
        keep[i + 1 :] &= np.divide(shared, union, out=np.zeros_like(shared), where=union > 0) <= threshold
    return keep


def suppress(detections: DataFrame, threshold: float, by: list[str], score: str = "confidence", order: str = "ord") -> DataFrame:
    """``detections`` (with ``x1, y1, x2, y2``) that survive suppression within their group.

    A group is one class of one frame, so it is small whatever the number of frames.
    """

    def many(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*by, score, order], ascending=[*[True] * len(by), False, True], kind="stable")
        corners = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)
        starts = rows[by].ne(rows[by].shift()).any(axis=1).to_numpy().nonzero()[0]
        keep = [kept_boxes(corners[i:j], threshold) for i, j in zip(starts, [*starts[1:], len(rows)], strict=True)]
        return rows[np.concatenate(keep)]

    return map_whole_groups(detections, by, many, detections.schema)


def overlapping_boxes(detections: DataFrame, threshold: float, by: list[str], score: str, order: str, tile: float) -> DataFrame:
    """``winner, loser``: pairs of a group that overlap by more than the threshold, the higher score (then smaller ``order``) first.

    Boxes meet in the tiles they cover, each pair only in that of the corner where its overlap begins.
    """
    corners = ("x1", "y1", "x2", "y2")
    at = {c: F.floor(F.col(c) / tile).cast("long") for c in corners}
    cells = detections.select(*by, order, score, *corners).withColumn("_u", F.explode(F.sequence(at["x1"], at["x2"]))).withColumn("_v", F.explode(F.sequence(at["y1"], at["y2"])))
    key = [*by, "_u", "_v"]
    a, b = (cells.select(*key, *[F.col(c).alias(f"{p}{c}") for c in (order, score, *corners)]) for p in "ab")
    left, top = F.greatest("ax1", "bx1"), F.greatest("ay1", "by1")
    shared = F.greatest(F.lit(0.0), F.least("ax2", "bx2") - left) * F.greatest(F.lit(0.0), F.least("ay2", "by2") - top)
    area = [(F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1")) for p in "ab"]
    union = area[0] + area[1] - shared
    first = (F.col(f"a{score}") > F.col(f"b{score}")) | ((F.col(f"a{score}") == F.col(f"b{score}")) & (F.col(f"a{order}") < F.col(f"b{order}")))
    here = (F.floor(left / tile) == F.col("_u")) & (F.floor(top / tile) == F.col("_v"))
    near = first & here & (union > 0) & (F.try_divide(shared, union) > threshold)
    return a.join(b, key).where(near).select(F.col(f"a{order}").alias("winner"), F.col(f"b{order}").alias("loser"))


def suppress_rounds(detections: DataFrame, threshold: float, by: list[str], score: str = "confidence", order: str = "ord", tile: float = 256.0) -> DataFrame:
    """``detections`` that survive suppression, as ``suppress``, by rounds over the graph of overlaps.

    In each round the boxes that no other box still beats are kept, and what they overlap goes. A group may be
    of any size: nothing of it is gathered, and there are as many rounds as the longest chain of boxes that beat
    one another. ``order`` must be unique; scores and corners are no nulls.
    """
    pairs = materialize(overlapping_boxes(detections, threshold, by, score, order, tile), "overlaps")
    gone = None
    while not pairs.isEmpty():
        best = pairs.select("winner").distinct().join(pairs.select(F.col("loser").alias("winner")), "winner", "left_anti")
        lost = materialize(pairs.join(best, "winner").select("loser").distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        left = pairs.join(lost, "loser", "left_anti").join(lost.withColumnRenamed("loser", "winner"), "winner", "left_anti")
        pairs = materialize(left, "overlaps")
    return detections if gone is None else detections.join(gone.withColumnRenamed("loser", order), order, "left_anti")


def best_class(scores: DataFrame, key: list[str], class_col: str = "class_id", score: str = "score") -> DataFrame:
    """The best class per key; of equal scores the lowest class. Also picks the best mask."""
    best = F.max_by(F.struct(class_col, score), F.struct(F.col(score), -F.col(class_col)))
    return scores.groupBy(*key).agg(best.alias("b")).select(*key, F.col(f"b.{class_col}").alias(class_col), F.col(f"b.{score}").alias(score))


def assign(scores: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns: as many finite scores as possible, then the greatest sum.

    Shortest augmenting paths with potentials; ``-inf`` marks pairs that are not allowed.
    """
    if not scores.size or not np.isfinite(scores).any():
        return []
    flipped = scores.shape[0] > scores.shape[1]
    cost = np.where(np.isfinite(scores), -scores, INFEASIBLE)
    cost = cost.T if flipped else cost
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        distance, previous, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last, sink = start, -1, -1
        low = 0.0
        while sink < 0:
            reach = low + cost[row] - row_price[row] - column_price
            better = ~done & (reach < distance)
            distance[better], previous[better] = reach[better], last
            last = int(np.argmin(np.where(done, np.inf, distance)))
            low, done[last] = distance[last], True
            if owner[last] < 0:
                sink = last
            else:
                row = owner[last]
        row_price[start] += low
        seen = done.copy()
        seen[sink] = False
        row_price[owner[seen]] += low - distance[seen]
        column_price[seen] -= low - distance[seen]
        while sink >= 0:
            before = previous[sink]
            owner[sink] = start if before < 0 else owner[before]
            sink = before
    pairs = [(int(r), c) for c, r in enumerate(owner) if r >= 0]
    pairs = [(c, r) for r, c in pairs] if flipped else pairs
    return sorted(p for p in pairs if np.isfinite(scores[p]))


def assignment(candidates: DataFrame, frame: str, row: str, column: str, score: str) -> DataFrame:
    """One-to-one pairs per frame from scored candidate pairs; a frame has a handful of detections."""
    schema = candidates.select(frame, row, column, score).schema

    def one(pairs: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(pairs[row], return_inverse=True)
        columns, c = np.unique(pairs[column], return_inverse=True)
        matrix = np.full((len(rows), len(columns)), -np.inf)
        matrix[r, c] = pairs[score]
        chosen = set(assign(matrix))
        return pairs[[(a, b) in chosen for a, b in zip(r, c, strict=True)]]

    def many(pairs: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([one(g) for _, g in pairs[[frame, row, column, score]].groupby(frame, sort=False)])

    return map_whole_groups(candidates, [frame], many, schema)


def score_order(boxes: DataFrame, score: str, order: str, by: Sequence[str]) -> DataFrame:
    """Boxes of all classes with their ``position`` in their frame, from 0, by falling score; equal scores by ``order``.

    Nulls come last. A frame's boxes are a window partition.
    """
    place = W.partitionBy(*by).orderBy(F.desc_nulls_last(score), order)
    return boxes.withColumn("position", F.row_number().over(place).cast("long") - 1)


def with_masks(frames: DataFrame, detections: str, masks: str, by: Sequence[str]) -> DataFrame:
    """A row ``by, detection_id, detection, mask`` for each detection that has a mask at its place in the frame's arrays.

    The longer array's rest has no partner and goes; a null array is empty. Detection ids are places from 0.
    """
    shorter = F.least(F.size(F.coalesce(detections, F.array().cast(frames.schema[detections].dataType))), F.size(F.coalesce(masks, F.array().cast(frames.schema[masks].dataType))))
    zipped = F.slice(F.arrays_zip(F.col(detections).alias("detection"), F.col(masks).alias("mask")), F.lit(1), shorter)
    return frames.select(*by, F.posexplode(zipped).alias("detection_id", "z")).select(*by, "detection_id", F.col("z.detection").alias("detection"), F.col("z.mask").alias("mask"))
