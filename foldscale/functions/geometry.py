"""Geometry as column expressions over x, y, z columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def xyz(prefix: str) -> Vector:
    """The columns of a struct ``prefix`` with fields x, y, z."""
    return F.col(f"{prefix}.x"), F.col(f"{prefix}.y"), F.col(f"{prefix}.z")


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(sub(a, b))


def torsion(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """The dihedral angle of four points in degrees; null where a point is missing or points are collinear."""
    b1, b2, b3 = sub(b, a), sub(c, b), sub(d, c)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    axis = norm(b2)
    fine = (norm(n1) >= 1e-9) & (norm(n2) >= 1e-9) & (axis >= 1e-9)
    y = dot(cross(n1, n2), b2) / F.when(axis >= 1e-9, axis)
    return F.when(fine, F.degrees(F.atan2(y, dot(n1, n2))))


def sphere_points(n: int = 92) -> list[tuple[float, float, float]]:
    """Points on the unit sphere along the golden spiral (fixed values: the spiral and its 92 points)."""
    turn, out = math.pi * (1.0 + math.sqrt(5.0)), []
    for k in range(n):
        y = 1.0 - 2.0 * (k + 0.5) / n
        r = math.sqrt(max(1.0 - y * y, 0.0))
        out.append((math.cos(turn * (k + 0.5)) * r, y, math.sin(turn * (k + 0.5)) * r))
    return out
