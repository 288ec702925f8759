"""Points, frames and polygons in the plane, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def turn_angle(dx0: Column, dy0: Column, dx1: Column, dy1: Column) -> Column:
    """Signed angle from one step to the next; a step straight back is pi."""
    return F.atan2(dx0 * dy1 - dy0 * dx1 + 0.0, dx0 * dx1 + dy0 * dy1)


def affine(x: Column, y: Column, m: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """A 2x3 (or 3x3) matrix applied to a point."""
    return m[0][0] * x + m[0][1] * y + m[0][2], m[1][0] * x + m[1][1] * y + m[1][2]


def to_egocentric(x: Column, y: Column, heading: Column, px: Column, py: Column) -> tuple[Column, Column]:
    """A point seen from (x, y) along ``heading``: ahead and to the left."""
    dx, dy = px - x, py - y
    return F.cos(heading) * dx + F.sin(heading) * dy, F.cos(heading) * dy - F.sin(heading) * dx


def to_allocentric(x: Column, y: Column, heading: Column, ex: Column, ey: Column) -> tuple[Column, Column]:
    return x + F.cos(heading) * ex - F.sin(heading) * ey, y + F.sin(heading) * ex + F.cos(heading) * ey


def bearing(x: Column, y: Column, heading: Column, px: Column, py: Column) -> Column:
    """Direction of a point against ``heading``, in (-pi, pi]."""
    ahead, left = to_egocentric(x, y, heading, px, py)
    return F.atan2(left, ahead)


#: Sides beyond which a polygon is an array that is gone through, and not code for each side.
MANY_SIDES = 12


def _sides(polygon: Sequence[tuple[float, float]]) -> Column:
    ends = zip(polygon, [*polygon[1:], polygon[0]])
    return F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("ax", "ay", "bx", "by"), (*a, *b))]) for a, b in ends])


def _in_many_sided(x: Column, y: Column, polygon: Sequence[tuple[float, float]], boundary: bool, tolerance: float = 1e-9) -> Column:
    def near(e: Column) -> Column:
        ax, ay, bx, by = (e[k] for k in ("ax", "ay", "bx", "by"))
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        length = F.greatest(F.lit(1.0), F.hypot(bx - ax, by - ay))
        within = x.between(F.least(ax, bx) - tolerance, F.greatest(ax, bx) + tolerance) & y.between(F.least(ay, by) - tolerance, F.greatest(ay, by) + tolerance)
        return (F.abs(cross) <= tolerance * length) & within

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = (e[k] for k in ("ax", "ay", "bx", "by"))
        return ((ay > y) != (by > y)) & (x < F.coalesce(F.try_divide((bx - ax) * (y - ay), by - ay), F.lit(0.0)) + ax)

    sides = _sides(polygon)
    odd = F.size(F.filter(sides, crosses)) % 2 == 1
    return F.when(F.exists(sides, near), F.lit(boundary)).otherwise(odd)


def on_boundary(x: Column, y: Column, polygon: Sequence[tuple[float, float]], tolerance: float = 1e-9) -> Column:
    found = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]]):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        within = x.between(min(ax, bx) - tolerance, max(ax, bx) + tolerance) & y.between(min(ay, by) - tolerance, max(ay, by) + tolerance)
        found = found | (F.abs(cross) <= tolerance * max(1.0, math.hypot(bx - ax, by - ay))) & within
    return found


def in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]], boundary: bool = True) -> Column:
    """Whether a point lies in a simple polygon, by edges that a ray crosses; on its boundary ``boundary``."""
    if len(polygon) > MANY_SIDES:
        return _in_many_sided(x, y, polygon, boundary)
    odd = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]]):
        if ay == by:
            continue
        crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        odd = odd != crosses
    edge = on_boundary(x, y, polygon)
    return F.when(edge, F.lit(boundary)).otherwise(odd)


def polygon_area(polygon: Sequence[tuple[float, float]]) -> float:
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]]))) / 2


def polygon_centroid(polygon: Sequence[tuple[float, float]]) -> tuple[float, float]:
    twice = cx = cy = 0.0
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]]):
        cross = ax * by - bx * ay
        twice, cx, cy = twice + cross, cx + (ax + bx) * cross, cy + (ay + by) * cross
    return cx / (3 * twice), cy / (3 * twice)
