"""Rotations (nine columns, row by row), rigid transforms (rotation and translation) and quaternions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec, add, dot, norm, scale, sub

Rotation = tuple[Column, ...]
Rigid = tuple[Rotation, Vec]

#: Names of a transform's upper three rows, row by row.
NAMES = [f"t{r}{c}" for r in range(1, 4) for c in range(1, 5)]


def _zero_one() -> tuple[Column, Column]:
    return F.lit(0.0), F.lit(1.0)


def rotx(a: Column) -> Rotation:
    o, i = _zero_one()
    c, s = F.cos(a), F.sin(a)
    return i, o, o, o, c, -s, o, s, c


def roty(a: Column) -> Rotation:
    o, i = _zero_one()
    c, s = F.cos(a), F.sin(a)
    return c, o, s, o, i, o, -s, o, c


def rotz(a: Column) -> Rotation:
    o, i = _zero_one()
    c, s = F.cos(a), F.sin(a)
    return c, -s, o, s, c, o, o, o, i


def rows(m: Rotation) -> tuple[Vec, Vec, Vec]:
    return m[0:3], m[3:6], m[6:9]


def transpose(m: Rotation) -> Rotation:
    return tuple(m[3 * r + c] for c in range(3) for r in range(3))


def multiply(a: Rotation, b: Rotation) -> Rotation:
    columns = rows(transpose(b))
    return tuple(dot(r, c) for r in rows(a) for c in columns)


def turn(m: Rotation, v: Vec) -> Vec:
    return tuple(dot(r, v) for r in rows(m))


def determinant(m: Rotation) -> Column:
    a, b, c, d, e, f, g, h, i = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def apply(t: Rigid, v: Vec) -> Vec:
    return add(turn(t[0], v), t[1])


def compose(a: Rigid, b: Rigid) -> Rigid:
    """First b, then a."""
    return multiply(a[0], b[0]), apply(a, b[1])


def invert(t: Rigid) -> Rigid:
    back = transpose(t[0])
    return back, scale(turn(back, t[1]), -1.0)


def from_columns(prefix: str = "") -> Rigid:
    c = [F.col(prefix + n) for n in NAMES]
    return (c[0], c[1], c[2], c[4], c[5], c[6], c[8], c[9], c[10]), (c[3], c[7], c[11])


def to_columns(t: Rigid, prefix: str = "") -> dict[str, Column]:
    m, v = t
    flat = [x for r in range(3) for x in (*m[3 * r : 3 * r + 3], v[r])]
    return {prefix + n: c for n, c in zip(NAMES, flat)}


def to_array(t: Rigid) -> Column:
    """Sixteen values, row by row."""
    o, i = _zero_one()
    return F.array(*to_columns(t).values(), o, o, o, i)


def literal(matrix: list[list[float]]) -> Rigid:
    m = tuple(F.lit(float(matrix[r][c])) for r in range(3) for c in range(3))
    return m, tuple(F.lit(float(matrix[r][3])) for r in range(3))


def copysign(size: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(size)).otherwise(F.abs(size))


def to_quaternion(m: Rotation) -> tuple[Column, Column, Column, Column]:
    """(w, x, y, z), of length 1. Roots of what rounding made negative are 0."""
    a, b, c, d, e, f, g, h, i = m
    root = lambda x: 0.5 * F.sqrt(F.greatest(x, F.lit(0.0)))
    q = (root(1 + a + e + i), copysign(root(1 + a - e - i), h - f), copysign(root(1 - a + e - i), c - g), copysign(root(1 - a - e + i), d - b))
    n = F.nullif(norm(q), F.lit(0.0))
    return tuple(x / n for x in q)


def from_quaternion(q: tuple[Column, Column, Column, Column]) -> Rotation:
    w, x, y, z = q
    return (
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def clamp(x: Column) -> Column:
    """To [-1, 1]: beyond it acos is NaN. Null stays null, which greatest() and least() would skip."""
    return F.when(x > 1, F.lit(1.0)).when(x < -1, F.lit(-1.0)).otherwise(x)


def distance(a: Rigid, b: Rigid) -> tuple[Column, Column]:
    """(distance of translations, angle between rotations from 0 to pi)."""
    trace = dot(a[0], b[0])
    return norm(sub(a[1], b[1])), F.acos(clamp((trace - 1) / 2))


def fold_angle(r: Column) -> Column:
    return F.when(r <= math.pi, r).otherwise(2 * math.pi - r)
