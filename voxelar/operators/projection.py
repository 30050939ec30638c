"""Depth pixels selected by boxes and masks, as points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelar.functions.geometry import back_project, valid_depth

#: Side of the tiles that boxes and pixels are joined on.
TILE = 64


def project_boxes(
    boxes: DataFrame, pixels: DataFrame, camera: dict[str, float], stride: int = 2, low: float = 0.3, high: float = 5.0
) -> DataFrame:
    """Points of the valid depth pixels in each box, on a grid that starts at the box's corner.

    ``boxes``: ``frame_id, detection_id, left, top, right, bottom`` (right and bottom
    excluded); ``pixels``: ``frame_id, u, v, depth``. Boxes are dealt to the tiles they
    touch, so one large box is spread over many keys, and meet only the pixels on their grid. A box without valid pixels has no rows.
    Spark takes the dealt boxes for as small as the boxes, so they are merged lest they be broadcast.
    """
    stride = max(1, int(stride))
    tiles = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE), F.floor((F.col(b) - 1) / TILE)))
    grid = lambda a, b: {"_gx": F.pmod(F.col(a), F.lit(stride)), "_gy": F.pmod(F.col(b), F.lit(stride))}
    dealt = boxes.where("right > left and bottom > top").withColumn("_tx", tiles("left", "right")).withColumn("_ty", tiles("top", "bottom"))
    cells = pixels.where(valid_depth(F.col("depth"), low, high)).withColumns(
        {"_tx": F.floor(F.col("u") / TILE), "_ty": F.floor(F.col("v") / TILE)} | grid("u", "v")
    )
    inside = "u >= left and u < right and v >= top and v < bottom"
    keys = ["_tx", "_ty", "_gx", "_gy"]
    joined = dealt.withColumns(grid("left", "top")).hint("merge").join(cells, ["frame_id", *keys]).where(inside).drop(*keys)
    return joined.withColumns(back_project(F.col("u"), F.col("v"), F.col("depth"), **camera))


def project_masks(
    masks: DataFrame, pixels: DataFrame, camera: dict[str, float], stride: int = 2, low: float = 0.1, high: float = 10.0
) -> DataFrame:
    """Points of the valid depth pixels under each mask, on a grid that starts at the image's corner.

    ``masks``: ``frame_id, detection_id, u, v`` for set pixels.
    """
    stride = max(1, int(stride))
    grid = (F.col("u") % stride == 0) & (F.col("v") % stride == 0)
    joined = masks.where(grid).join(pixels.where(grid & valid_depth(F.col("depth"), low, high)), ["frame_id", "u", "v"])
    return joined.withColumns(back_project(F.col("u"), F.col("v"), F.col("depth"), **camera))


def erode_masks(masks: DataFrame, width: int, height: int, reach: int = 1) -> DataFrame:
    """Mask pixels whose whole neighbourhood inside the image is set; ``masks`` has each set pixel once.

    A square is a row of columns, so rows are eroded first and columns of what is left
    after them; each pixel stays one row throughout.
    """
    for axis, other, limit in (("u", "v", width), ("v", "u", height)):
        beside = W.partitionBy("frame_id", "detection_id", other).orderBy(axis).rangeBetween(-reach, reach)
        span = F.least(F.col(axis) + reach, F.lit(limit - 1)) - F.greatest(F.col(axis) - reach, F.lit(0)) + 1
        masks = masks.withColumn("_n", F.count("*").over(beside)).where(F.col("_n") == span).drop("_n")
    return masks


def mask_areas(masks: DataFrame) -> DataFrame:
    """Set pixels of every mask."""
    return masks.groupBy("frame_id", "detection_id").agg(F.count("*").alias("area"))


def resize_masks(masks: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Set pixels of masks scaled by nearest neighbour from ``source`` to ``target`` (width, height)."""

    def targets(c: str, s: int, t: int):
        # Target pixels p with floor(p * s / t) = c.
        first, last = F.ceil(F.col(c) * t / F.lit(float(s))), F.ceil((F.col(c) + 1) * t / F.lit(float(s))) - 1
        return F.explode(F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>")))

    wide = masks.withColumn("_u", targets("u", source[0], target[0])).withColumn("_v", targets("v", source[1], target[1]))
    return wide.select("frame_id", "detection_id", F.col("_u").alias("u"), F.col("_v").alias("v"))
