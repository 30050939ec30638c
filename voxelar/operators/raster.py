"""Top-down rasters: points and boxes as pixels of a layout, the topmost of each kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelar.functions.geometry import to_pixel

#: Side of a raster's tiles in pixels.
TILE = 256


def _placed(rows: DataFrame, layout: DataFrame, x: str, y: str, u: str, v: str) -> DataFrame:
    found = rows.crossJoin(F.broadcast(layout))  # one row
    at = to_pixel(F.col(x), F.col(y))
    return found.select(*rows.columns, at["u"].alias(u), at["v"].alias(v), "width", "height")


def _topmost(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("u", "v").agg(F.max_by(F.struct("rgb", "draw"), "draw").alias("top")).select("u", "v", "top.rgb", "top.draw")


def point_pixels(points: DataFrame, layout: DataFrame, rank: Column, order: str, rgb: Column, radius: int = 1) -> DataFrame:
    """``u, v, rgb, draw``: points drawn as plus signs with arms of ``radius`` pixels, kept inside the canvas.

    Later objects (``rank``) cover earlier ones; within an object all centres come first, then
    the arms from inside out, and within each the points by ``order``. Points that fall on
    one pixel are settled before arms are drawn, so at most a canvas of rows is multiplied.
    """
    placed = _placed(points.select(rank.cast("long").alias("rank"), F.col(order).cast("long").alias("ord"), rgb.cast("long").alias("rgb"), "x", "y"), layout, "x", "y", "u", "v")
    last = placed.groupBy("rank", "u", "v", "width", "height").agg(F.max_by("rgb", "ord").alias("rgb"), F.max("ord").alias("ord"))
    arms = [(0, 0), *[(d * i, d * j) for d in range(1, radius + 1) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]]
    offsets = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, (i, j) in enumerate(arms)])
    drawn = last.withColumn("arm", F.explode(offsets))
    u = F.greatest(F.lit(0), F.least(F.col("width") - 1, F.col("u") + F.col("arm.i")))
    v = F.greatest(F.lit(0), F.least(F.col("height") - 1, F.col("v") + F.col("arm.j")))
    draw = F.struct(F.lit(0).alias("layer"), "rank", F.col("arm.n").alias("step"), "ord")
    return _topmost(drawn.select(u.alias("u"), v.alias("v"), "rgb", draw.alias("draw")))


def box_pixels(boxes: DataFrame, layout: DataFrame, rank: Column, rgb: Column, width: int = 2) -> DataFrame:
    """Outlines of boxes ``lo_x, lo_y, hi_x, hi_y``, ``width`` pixels inwards, above all points; later ranks cover earlier ones."""
    rows = boxes.select(rank.cast("long").alias("rank"), rgb.cast("long").alias("rgb"), *[F.col(f"{p}_{a}") for p in ("lo", "hi") for a in "xy"])
    low = _placed(rows, layout, "lo_x", "lo_y", "u1", "v2").drop("width", "height")
    both = _placed(low, layout, "hi_x", "hi_y", "u2", "v1")
    inside = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    rings = both.withColumn("d", inside).select(
        "rank", "rgb", *[(F.col(c) + F.col("d")).alias(c) for c in ("u1", "v1")], *[(F.col(c) - F.col("d")).alias(c) for c in ("u2", "v2")]
    ).where("u1 <= u2 and v1 <= v2")
    # An outline is as long as the canvas is wide, not as its object has points.
    flat = rings.withColumn("u", F.explode(F.sequence("u1", "u2"))).withColumn("v", F.explode(F.array("v1", "v2")))
    upright = rings.withColumn("v", F.explode(F.sequence("v1", "v2"))).withColumn("u", F.explode(F.array("u1", "u2")))
    draw = F.struct(F.lit(1).alias("layer"), "rank", F.lit(0).alias("step"), F.lit(0).cast("long").alias("ord"))
    return _topmost(flat.unionByName(upright).select("u", "v", "rgb", draw.alias("draw")))


def raster(*layers: DataFrame) -> DataFrame:
    """``u, v, rgb``: the topmost pixels of all layers."""
    pixels = layers[0]
    for layer in layers[1:]:
        pixels = pixels.unionByName(layer)
    return _topmost(pixels).select("u", "v", "rgb")


def tiles(pixels: DataFrame, background: int = 246, side: int = TILE) -> DataFrame:
    """``tile_u, tile_v, image``: squares of ``side`` pixels that hold any, as rows of RGB bytes.

    A tile's pixels are the only ones that come together, so a picture of any size is
    painted by as many tasks as it has tiles.
    """
    keyed = pixels.select(*[F.floor(F.col(c) / side).cast("int").alias(f"tile_{c}") for c in "uv"], *[(F.col(c) % side).alias(c) for c in "uv"], "rgb")

    def paint(table: pa.Table) -> pa.Table:
        image = np.full((side, side, 3), background, np.uint8)
        u, v, rgb = (table.column(c).to_numpy() for c in ("u", "v", "rgb"))
        image[v, u] = np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=1)
        at = [table.column(f"tile_{c}")[0].as_py() for c in "uv"]
        return pa.table([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([image.tobytes()])], ["tile_u", "tile_v", "image"])

    return keyed.groupBy("tile_u", "tile_v").applyInArrow(paint, "tile_u int, tile_v int, image binary")
