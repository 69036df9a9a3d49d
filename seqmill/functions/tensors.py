"""Expressions over arrays of points: picks, projections, normalised joints, bones and fixed lengths.

A point is an array of coordinates; a point of zeros is a missing one. All are built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs of joints that make the bones of a 17-joint skeleton, and its two ankles.
BONES = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 6), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16)]
ANKLES = (15, 16)


def _x(p: Column) -> Column:
    return F.get(p, F.lit(0))


def _y(p: Column) -> Column:
    return F.get(p, F.lit(1))


def frame_at(points: Column, offset: Column) -> Column:
    """The point at ``offset``, held within the array; null for an empty one."""
    return F.get(points, F.least(F.greatest(offset, F.lit(0)), F.size(points) - 1).cast("int"))


def last_visible(points: Column) -> Column:
    """The last point that is not missing, or null."""
    return F.try_element_at(F.filter(points, lambda p: F.exists(p, lambda v: v != 0)), F.lit(-1))


def project(point: Column, matrix: list[list[float]]) -> Column:
    """A point through a 3 x 3 homography; null on its horizon."""
    a, b, c = (sum((v * w for v, w in zip((_x(point), _y(point)), row[:2], strict=True)), F.lit(float(row[2]))) for row in matrix)
    return F.when(c != 0, F.array(a / c, b / c))


def inverse(m: list[list[float]]) -> list[list[float]]:
    """The homography back: the adjugate, as scale does not count."""
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    return [[minor(j, i) for j in range(3)] for i in range(3)]


def on_unit_court(point: Column, left: float, right: float, up: float, down: float) -> Column:
    """Court coordinates as shares of the way from left to right and from up to down."""
    return F.when(point.isNotNull(), F.array((_x(point) - left) / (right - left), (_y(point) - up) / (down - up)))


def sure_joints(points: Column, scores: Column, least: float) -> Column:
    """Joints whose score is under ``least`` become missing."""
    return F.zip_with(points, scores, lambda p, s: F.when(s >= least, p).otherwise(F.transform(p, lambda v: F.lit(0.0))))


def unit_joints(points: Column, box: Column) -> Column:
    """Joints seen from the centre of the box (x1, y1, x2, y2) in units of its diagonal, one at least; missing ones stay zero."""
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) for i in range(4))
    unit = F.greatest(F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), F.lit(1.0))
    return F.transform(points, lambda p: F.when(F.exists(p, lambda v: v > 0), F.array((_x(p) - (x1 + x2) / 2) / unit, (_y(p) - (y1 + y2) / 2) / unit)).otherwise(F.array(F.lit(0.0), F.lit(0.0))))


def feet(points: Column, box: Column, ankles: tuple[int, int] = ANKLES) -> Column:
    """The mean of the ankles that are seen, else the middle of the lower edge of the box."""
    seen = F.filter(F.array(*[F.get(points, F.lit(i)) for i in ankles]), lambda p: F.exists(p, lambda v: v > 0))
    mean = lambda of: F.aggregate(seen, F.lit(0.0), lambda total, p: total + of(p)) / F.size(seen)
    return F.when(F.size(seen) > 0, F.array(mean(_x), mean(_y))).otherwise(F.array((F.get(box, F.lit(0)) + F.get(box, F.lit(2))) / 2, F.get(box, F.lit(3))))


def framed(x: Column, y: Column, width: float, height: float, visible: Column) -> Column:
    """A point in shares of the frame; zeros where it is not visible."""
    return F.when(visible & F.lit(width > 0 and height > 0), F.array(x / (width or 1), y / (height or 1))).otherwise(F.array(F.lit(0.0), F.lit(0.0)))


def thinned(points: Column, n: int) -> Column:
    """Every stride-th point, ``n`` at most; the stride is rounded to the nearer whole number."""
    size = F.size(points)
    stride = F.when(size > n, F.floor(size / n) + (size % n > n // 2).cast("int")).otherwise(1)
    return F.slice(F.filter(points, lambda p, i: i % stride == 0), 1, n)


def padded(points: Column, n: int, zero: Column) -> Column:
    """``points`` and as many of ``zero`` as make ``n``."""
    return F.concat(points, F.array_repeat(zero, F.greatest(F.lit(n) - F.size(points), F.lit(0))))


def _paired(points: Column, pairs: list[tuple[int, int]], value) -> Column:
    both = lambda u, v: F.when((u != 0) & (v != 0), value(u, v)).otherwise(F.lit(0.0))
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return F.transform(ends, lambda s: F.zip_with(F.get(points, s["a"]), F.get(points, s["b"]), both))


def bones(points: Column, pairs: list[tuple[int, int]] = BONES) -> Column:
    """From the first joint of each pair to the second; a coordinate that either lacks is zero."""
    return _paired(points, pairs, lambda u, v: v - u)


def mid_joints(points: Column, pairs: list[tuple[int, int]] = BONES) -> Column:
    """The middle of each pair; a coordinate that either lacks is zero."""
    return _paired(points, pairs, lambda u, v: (u + v) / 2)


def pose_variants(points: Column, pairs: list[tuple[int, int]] = BONES) -> dict[str, Column]:
    """The four ways to lay joints, mid-joints and bones one after the other."""
    middle, bone = mid_joints(points, pairs), bones(points, pairs)
    return {"J": points, "JnB_interp": F.concat(points, middle), "JnB_bone": F.concat(points, bone), "Jn2B": F.concat(points, middle, bone)}
