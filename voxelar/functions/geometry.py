"""Column expressions for points, boxes, poses and pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Extents below this count as this in box volume ratios (a fixed value).
FLAT = 0.02


def voxel_key(value: Column, size: float, narrow: bool = False) -> Column:
    """Cell of a coordinate. ``narrow`` divides as single-precision numbers would."""
    if size <= 0:
        raise ValueError("voxel size must be positive")
    if not narrow:
        return F.floor(value.cast("double") / F.lit(float(size))).cast("long")
    quotient = value.cast("float").cast("double") / F.lit(float(size)).cast("float").cast("double")
    return F.floor(quotient.cast("float")).cast("long")


def packed_key(kx: Column, ky: Column, kz: Column, bits: int = 21) -> Column:
    """Three signed cells in one sortable long; null if one does not fit its bits."""
    bias = 1 << bits - 1
    fits = [(k >= -bias) & (k < bias) for k in (kx, ky, kz)]
    packed = F.shiftleft(kx + bias, 2 * bits).bitwiseOR(F.shiftleft(ky + bias, bits)).bitwiseOR(kz + bias)
    return F.when(fits[0] & fits[1] & fits[2], packed)


def is_finite(*values: Column) -> Column:
    """True where every value is a finite number; false for nulls."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))
    return ok


def valid_depth(depth: Column, low: float, high: float) -> Column:
    """Inclusive range; NaN and infinities fall outside any finite range."""
    return F.coalesce(depth.between(float(low), float(high)), F.lit(False))


def back_project(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> dict[str, Column]:
    """Pinhole camera: a pixel and its depth as a point in camera axes."""
    if fx <= 0 or fy <= 0:
        raise ValueError("focal lengths must be positive")
    z = depth.cast("double")
    return {"x": (u - F.lit(float(cx))) * z / F.lit(float(fx)), "y": (v - F.lit(float(cy))) * z / F.lit(float(fy)), "z": z}


def rescaled_center(pixel: Column, source: Column | float, target: Column | float) -> Column:
    """A pixel's centre carried from an image of ``target`` pixels to one of ``source``."""
    return (pixel + 0.5) * source / target - 0.5


def apply_matrix(x: Column, y: Column, z: Column, m: Sequence[Column | float]) -> dict[str, Column]:
    """A row-major 4 x 4 pose (or its first three rows) applied to a point, in double precision."""
    at = [c if isinstance(c, Column) else F.lit(float(c)) for c in m]
    p = [c.cast("double") for c in (x, y, z)]
    rows = [at[4 * i] * p[0] + at[4 * i + 1] * p[1] + at[4 * i + 2] * p[2] + at[4 * i + 3] for i in range(3)]
    return dict(zip(AXES, rows, strict=True))


def quaternion_rows(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any length; one near zero turns nothing."""
    n = x * x + y * y + z * z + w * w
    s = F.when(n < 1e-12, F.lit(0.0)).otherwise(F.try_divide(F.lit(2.0), n))
    return [
        [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)],
    ]


def apply_quaternion(point: Sequence[Column], rotation: Sequence[Column], shift: Sequence[Column]) -> dict[str, Column]:
    rows = quaternion_rows(*rotation)
    return {a: r[0] * point[0] + r[1] * point[1] + r[2] * point[2] + t for a, r, t in zip(AXES, rows, shift, strict=True)}


def slerp(p: Sequence[Column], q: Sequence[Column], part: Column) -> list[Column]:
    """The rotation ``part`` of the way from ``p`` to ``q`` (quaternions x, y, z, w) along the shorter arc.

    Nearly equal rotations are interpolated by their numbers; the result has length one.
    """
    unit = [[c / F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0])) for c in v] for v in (p, q)]
    dot = sum((a * b for a, b in zip(unit[0][1:], unit[1][1:], strict=True)), unit[0][0] * unit[1][0])
    turn, near = F.when(dot < 0, -1.0).otherwise(1.0), F.least(F.abs(dot), F.lit(1.0))
    angle = F.acos(near)
    straight = near > 0.9995
    a = F.when(straight, 1 - part).otherwise(F.try_divide(F.sin((1 - part) * angle), F.sin(angle)))
    b = F.when(straight, part).otherwise(F.try_divide(F.sin(part * angle), F.sin(angle))) * turn
    mixed = [x * a + y * b for x, y in zip(*unit, strict=True)]
    length = F.sqrt(sum((c * c for c in mixed[1:]), mixed[0] * mixed[0]))
    return [c / length for c in mixed]


def _turned(p: Sequence[Column], q: Sequence[Column]) -> list[Column]:
    """A point turned by a quaternion of length one."""
    (x, y, z), (a, b, c, w) = p, q
    t = [2 * (b * z - c * y), 2 * (c * x - a * z), 2 * (a * y - b * x)]
    return [x + w * t[0] + b * t[2] - c * t[1], y + w * t[1] + c * t[0] - a * t[2], z + w * t[2] + a * t[1] - b * t[0]]


def _parts(pose: Column) -> tuple[list[Column], list[Column]]:
    """Shift and rotation of a pose."""
    return [pose[a] for a in AXES], [pose[c] for c in ("qx", "qy", "qz", "qw")]


def _pose(shift: Sequence[Column], turn: Sequence[Column]) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((*shift, *turn), (*AXES, "qx", "qy", "qz", "qw"), strict=True)])


def pose_product(first: Column, second: Column) -> Column:
    """The pose ``first * second`` of structs ``x, y, z, qx, qy, qz, qw`` with quaternions of length one: what ``second`` does, then ``first``."""
    (t, p), (u, q) = _parts(first), _parts(second)
    moved = [a + b for a, b in zip(_turned(u, p), t, strict=True)]
    (a, b, c, w), (x, y, z, v) = p, q
    return _pose(moved, [w * x + a * v + b * z - c * y, w * y - a * z + b * v + c * x, w * z + a * y - b * x + c * v, w * v - a * x - b * y - c * z])


def inverse_pose(pose: Column) -> Column:
    """The pose that undoes another, whose quaternion has length one."""
    t, q = _parts(pose)
    back = [-q[0], -q[1], -q[2], q[3]]
    return _pose([-c for c in _turned(t, back)], back)


def prompt_box(box: Sequence[Column], width: Column, height: Column, side: int = 1024) -> list[Column]:
    """A box as a prompt for an image whose longer side is resized to ``side``: clamped to the image, then scaled."""
    size = longest_side(width, height, side)
    scale = {n: size[n] / s.cast("double") for n, s in (("width", width), ("height", height))}
    limits = [("width", width), ("height", height)] * 2
    return [clip(c, 0.0, F.greatest(s - 1, F.lit(0)).cast("double")) * scale[n] for c, (n, s) in zip(box, limits, strict=True)]


def clip(value: Column, low: Column | float | int, high: Column | float | int) -> Column:
    as_column = [c if isinstance(c, Column) else F.lit(c) for c in (low, high)]
    return F.greatest(as_column[0], F.least(as_column[1], value))


def scaled_box(box: Sequence[Column], source: Sequence[Column], target: Sequence[Column]) -> Column:
    """A box carried between image sizes, rounded outwards and clipped.

    Null for non-finite corners, sizes that are not positive, and boxes left empty.
    Fields ``left, top, right, bottom`` (int); corners may come in any order.
    """
    (x1, y1, x2, y2), (sw, sh), (tw, th) = box, source, target
    sx, sy = F.try_divide(tw.cast("double"), sw.cast("double")), F.try_divide(th.cast("double"), sh.cast("double"))

    def side(value: Column, limit: Column) -> Column:
        return clip(value, F.lit(0.0), limit.cast("double")).cast("int")

    left, right = side(F.floor(F.least(x1, x2) * sx).cast("double"), tw), side(F.ceil(F.greatest(x1, x2) * sx).cast("double"), tw)
    top, bottom = side(F.floor(F.least(y1, y2) * sy).cast("double"), th), side(F.ceil(F.greatest(y1, y2) * sy).cast("double"), th)
    fine = is_finite(x1, y1, x2, y2) & (F.least(sw, sh, tw, th) > 0) & (right > left) & (bottom > top)
    return F.when(fine, F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def bounds_near(a: str, b: str, margin: float) -> Column:
    """Whether two boxes, given as columns ``{a}lo_x`` to ``{b}hi_z``, come within ``margin`` on every axis."""
    near = F.lit(True)
    for k in AXES:
        near = near & (F.col(f"{a}lo_{k}") <= F.col(f"{b}hi_{k}") + margin) & (F.col(f"{b}lo_{k}") <= F.col(f"{a}hi_{k}") + margin)
    return near


def box_overlap(a: str, b: str) -> Column:
    """Shared volume over the smaller volume, with flat extents counted as FLAT in the latter."""
    shared, size_a, size_b = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for k in AXES:
        lo_a, hi_a, lo_b, hi_b = (F.col(f"{p}{e}_{k}").cast("double") for p in (a, b) for e in ("lo", "hi"))
        shared = shared * F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
        size_a = size_a * F.greatest(hi_a - lo_a, F.lit(FLAT))
        size_b = size_b * F.greatest(hi_b - lo_b, F.lit(FLAT))
    return shared / F.least(size_a, size_b)


def growth_valid(old: str, new: str, voxel: float, growth: float, radius: float) -> Column:
    """Whether taking in box ``new`` leaves every extent of box ``old`` within its allowed growth."""
    fine = F.lit(True)
    for k in AXES:
        lo, hi = F.col(f"{old}lo_{k}"), F.col(f"{old}hi_{k}")
        merged = F.greatest(hi, F.col(f"{new}hi_{k}")) - F.least(lo, F.col(f"{new}lo_{k}"))
        fine = fine & (merged <= F.greatest(hi - lo, F.lit(float(voxel))) * max(1.0, growth) + radius)
    return fine


def to_pixel(x: Column, y: Column, layout: str = "", clipped: bool = True) -> dict[str, Column]:
    """Map metres to pixels of a top-down layout (columns as from ``fit_layout``); y points up, ties round to even."""
    c = lambda n: F.col(f"{layout}{n}")
    u = F.rint((x - c("min_x")) * c("scale") + c("offset_x"))
    v = F.rint(c("height") - 1 - ((y - c("min_y")) * c("scale") + c("offset_y")))
    if clipped:
        u, v = clip(u, F.lit(0.0), c("width") - 1.0), clip(v, F.lit(0.0), c("height") - 1.0)
    return {"u": u.cast("int"), "v": v.cast("int")}


def letterbox(width: Column, height: Column, side: int) -> dict[str, Column]:
    """Scale and padding that fit an image into a square of ``side`` pixels."""
    ratio = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    new_w, new_h = F.rint(width * ratio), F.rint(height * ratio)
    return {"ratio": ratio, "pad_x": F.floor((side - new_w) / 2).cast("double"), "pad_y": F.floor((side - new_h) / 2).cast("double")}


def from_letterbox(value: Column, pad: Column, ratio: Column, limit: Column) -> Column:
    """A coordinate of the square back in the image, kept inside it."""
    return clip((value - pad) / ratio, F.lit(0.0), limit - 1.0)


def decoded_box(gx: Column, gy: Column, left: Column, top: Column, right: Column, bottom: Column, stride: Column) -> list[Column]:
    """Corners of an anchor-free prediction: distances from a cell's centre in strides."""
    cx, cy = gx + 0.5, gy + 0.5
    return [(cx - left) * stride, (cy - top) * stride, (cx + right) * stride, (cy + bottom) * stride]


def longest_side(width: Column, height: Column, side: int) -> dict[str, Column]:
    """Image size after scaling its longer side to ``side``, halves rounded up."""
    scale = F.lit(float(side)) / F.greatest(width, height)
    return {"scale": scale, "width": F.floor(width * scale + 0.5).cast("int"), "height": F.floor(height * scale + 0.5).cast("int")}
