"""Point-pair features, their quantization, and the angle by which a pair turns about its normal."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rigid import Rigid, clamp, turn
from .vectors import Vec, dot, norm, ratio, sub

#: Angles are cut into so many bins.
N_ANGLE = 30
D_ANGLE = 2 * math.pi / N_ANGLE


def quantize_down(x: Column, step: Column | float) -> Column:
    """x less its remainder, which has the sign of x."""
    return x - x % step


def quantize_floor(x: Column, step: Column | float) -> Column:
    """The multiple of step below x, also for negative x."""
    return x - F.pmod(x, step if isinstance(step, Column) else F.lit(float(step)))


def bin_of(x: Column, step: Column | float) -> Column:
    return F.round(quantize_down(x, step) / step).cast("long")


def _angle(a: Vec, b: Vec) -> Column:
    """Null if either has no length."""
    return F.acos(clamp(ratio(dot(a, b), norm(a) * norm(b))))


def pair_features(p: Vec, n: Vec, q: Vec, m: Vec) -> tuple[Column, Column, Column, Column]:
    """Of points p and q with normals n and m: their distance, the angles of either normal with the line
    from p to q, and the angle between the normals. Angles are null for points that coincide and for
    normals of length 0."""
    d = sub(q, p)
    return norm(d), _angle(n, d), _angle(m, d), _angle(n, m)


def bins(features: tuple[Column, ...], d_dist: Column | float, d_angle: float = D_ANGLE) -> list[Column]:
    return [bin_of(features[0], d_dist), *(bin_of(f, d_angle) for f in features[1:])]


def frame_angles(n: Vec) -> tuple[Column, Column]:
    """(about y, about z): the turns that bring the normal n onto the x axis."""
    y = F.atan2(n[2], n[0])
    return y, -F.atan2(n[1], F.cos(y) * n[0] + F.sin(y) * n[2])


def frame_terms(n: Vec) -> tuple[Column, Column, Column, Column]:
    """Cosine and sine of frame_angles(), of y and then of z."""
    y, z = frame_angles(n)
    return F.cos(y), F.sin(y), F.cos(z), F.sin(z)


def side_angle_of(d: Vec, cy: Column, sy: Column, cz: Column, sz: Column) -> Column:
    """side_angle() of the line d, by the frame_terms() of the normal."""
    return F.atan2(-sy * d[0] + cy * d[2], sz * (cy * d[0] + sy * d[2]) + cz * d[1])


def side_angle(p: Vec, n: Vec, q: Vec) -> Column:
    """The angle about the x axis at which q lies once p is the origin and n the x axis."""
    return side_angle_of(sub(q, p), *frame_terms(n))


def wrap(a: Column) -> Column:
    """A difference of two angles, into (-pi, pi]."""
    return F.when(a > math.pi, a - 2 * math.pi).when(a <= -math.pi, a + 2 * math.pi).otherwise(a)


def alpha_bin(scene_angle: Column, model_angle: Column, d_angle: float = D_ANGLE) -> Column:
    """The bin of the turn from the model's pair to the scene's: 0 to N_ANGLE - 1, the last one closed."""
    alpha = wrap(scene_angle - model_angle)
    return F.least(bin_of(alpha + math.pi, d_angle), F.lit(round(2 * math.pi / d_angle) - 1))


def bin_angle(k: Column, d_angle: float = D_ANGLE) -> Column:
    """The lower edge of an alpha bin."""
    return k * d_angle - math.pi


def moved(t: Rigid, p: Vec, n: Vec) -> tuple[Vec, Vec]:
    """A point and its normal under t."""
    x = turn(t[0], p)
    return tuple(a + b for a, b in zip(x, t[1])), turn(t[0], n)


