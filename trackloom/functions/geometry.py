"""Plane geometry as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cross_side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Sign of the cross product: 1 left of a -> b, -1 right of it, 0 on it."""
    return F.signum((bx - ax) * (y - ay) - (by - ay) * (x - ax))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of (x, y) from the segment a-b."""
    dx, dy = bx - ax, by - ay
    d2 = dx * dx + dy * dy
    u = F.when(d2 > 0, F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / F.when(d2 > 0, d2), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = x - ax - u * dx, y - ay - u * dy
    return F.sqrt(ex * ex + ey * ey)


def apply_matrix(h: list[Column], u: Column, v: Column) -> tuple[Column, Column, Column]:
    """(X, Y, w) of the 3x3 matrix h, row by row, applied to (u, v, 1), not yet divided by w."""
    return h[0] * u + h[1] * v + h[2], h[3] * u + h[4] * v + h[5], h[6] * u + h[7] * v + h[8]


def polyline_length(xs: Column, ys: Column) -> Column:
    """Length of the line through array columns of coordinates."""
    n = F.size(xs)
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda a, k: a + F.sqrt(F.pow(F.get(xs, k) - F.get(xs, k - 1), 2) + F.pow(F.get(ys, k) - F.get(ys, k - 1), 2))))
