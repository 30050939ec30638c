"""Column expressions for colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplier of the stable colours and the golden hue step.
SPREAD = 2654435761
GOLDEN = 0.618033988749895


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """0xRRGGBB as a long."""
    r, g, b = (c.cast("long").bitwiseAND(255) for c in (r, g, b))
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack_rgb(packed: Column) -> dict[str, Column]:
    return {c: F.shiftright(packed, s).bitwiseAND(255).cast("int") for c, s in (("r", 16), ("g", 8), ("b", 0))}


def stable_color(number: Column) -> dict[str, Column]:
    """A fixed, never dark colour for an id."""
    mixed = (number.cast("long") * F.lit(SPREAD)).bitwiseAND(0xFFFFFFFF)
    return {c: (F.shiftright(mixed, s).bitwiseAND(0xBF) + 64).cast("int") for c, s in (("r", 16), ("g", 8), ("b", 0))}


def class_color(class_id: Column) -> Column:
    """The packed colour of a class without an image: that of the next id, red and blue exchanged."""
    c = stable_color(class_id + 1)
    return pack_rgb(c["b"], c["g"], c["r"])


def hue_color(number: Column, saturation: float = 0.78, value: float = 0.86) -> dict[str, Column]:
    """A colour whose hue steps by the golden ratio, as channels 0 to 255."""
    h6 = F.pmod(number * F.lit(GOLDEN), F.lit(1.0)) * 6
    part, low = h6 - F.floor(h6), value * (1 - saturation)
    down, up = value * (1 - saturation * part), value * (1 - saturation * (1 - part))
    top, bottom = F.lit(float(value)), F.lit(float(low))
    order = {
        "r": (top, down, bottom, bottom, up, top),
        "g": (up, top, top, down, bottom, bottom),
        "b": (bottom, bottom, up, top, top, down),
    }

    def pick(choices):
        out = F.when(F.floor(h6) == 0, choices[0])
        for i, c in enumerate(choices[1:], 1):
            out = out.when(F.floor(h6) == i, c)
        return F.rint(out * 255).cast("int")

    return {c: pick(v) for c, v in order.items()}


def sample_nearest(uv: Column, width: Column, source_width: Column, up: bool = False) -> Column:
    """Index of the image pixel under a rescaled position: nearest (``up``) or the cell it falls into; clamped."""
    moved = (uv + 0.5) * width / source_width
    index = F.rint(moved - 0.5) if up else F.floor(moved)
    return F.greatest(F.lit(0), F.least(width.cast("int") - 1, index.cast("int")))
