"""Arithmetic of 3-vectors held as three columns, and of packed vote codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(x: str, y: str, z: str) -> Vec:
    return F.col(x), F.col(y), F.col(z)


def literal(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        out = out + p * q
    return out


def norm(a: tuple[Column, ...]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def largest(a: tuple[Column, ...]) -> Column:
    return F.greatest(*a)


def smallest(a: tuple[Column, ...]) -> Column:
    return F.least(*a)


def ratio(a: Column, b: Column) -> Column:
    """Null where b is 0: under ANSI rules a plain division would end the query."""
    return a / F.nullif(b, F.lit(0.0))


def same_bits(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = F.lit(True)
    for p, q in zip(a, b):
        out = out & (p == q)
    return out


def before(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Lexicographic order of components."""
    return F.struct(*a) < F.struct(*b)


def any_set(a: tuple[Column, ...]) -> Column:
    out = F.lit(False)
    for p in a:
        out = out | (p != 0)
    return out


def high_32(code: Column) -> Column:
    return F.shiftrightunsigned(code, 32)


def low_32(code: Column) -> Column:
    return code.bitwiseAND(F.lit(4294967295))


def pack_vote(scene_ref: Column, model_ref: Column, alpha: Column) -> Column:
    """scene_ref in bits 63 to 32, model_ref in 31 to 6, alpha in 5 to 0."""
    return F.shiftleft(scene_ref.cast("long"), 32).bitwiseOR(F.shiftleft(model_ref.cast("long"), 6)).bitwiseOR(alpha.cast("long"))


def unpack_vote(code: Column) -> tuple[Column, Column, Column]:
    low = low_32(code)
    return high_32(code), F.shiftright(low, 6), low.bitwiseAND(F.lit(63))
