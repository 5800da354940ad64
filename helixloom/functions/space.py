"""Column functions over 3-vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minus(u: Column, v: Column) -> Column:
    return F.array(*[v[k] - u[k] for k in range(3)])


def dot(u: Column, v: Column) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def distance(u: Column, v: Column) -> Column:
    return norm(minus(u, v))


def angle(p: Column, q: Column) -> Column:
    """Degrees between two vectors, 0 or 180 where rounding leaves the cosine outside -1 to 1; null for a zero vector."""
    c = dot(p, q) / F.nullif(norm(p) * norm(q), F.lit(0.0))
    return F.when(c > 1, 0.0).when(c < -1, 180.0).otherwise(F.degrees(F.acos(c)))


def may_pair(r1: Column, b1: Column, r2: Column, b2: Column, cutoff: float, most: float) -> Column:
    """Whether two nucleotides are within the cutoff and the base vector of each points to the other within the angle."""
    return (distance(r1, r2) <= cutoff) & (angle(b1, minus(r1, r2)) <= most) & (angle(b2, minus(r2, r1)) <= most)


def turned(x: Column, y: Column, degrees: float, origin: tuple[Column | float, Column | float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """A point turned about the origin, clockwise as a page shows it, where y grows downwards."""
    import math

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = x - origin[0], y - origin[1]
    return origin[0] + c * dx - s * dy, origin[1] + s * dx + c * dy
