"""Scenes with a model put into them at a known pose."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rigid
from ..functions import vectors as V
from .clouds import FIELDS, centroids, transformed


def random_quaternion(seed: int) -> tuple[float, float, float, float]:
    """Uniform over rotations; (w, x, y, z)."""
    r = random.Random(seed)
    u, a, b = r.random(), 2 * math.pi * r.random(), 2 * math.pi * r.random()
    return math.sqrt(u) * math.cos(b), math.sqrt(1 - u) * math.sin(a), math.sqrt(1 - u) * math.cos(a), math.sqrt(u) * math.sin(b)


def random_move(seed: int) -> tuple[float, float, float]:
    r = random.Random(seed + 1)
    return r.random(), r.random(), r.random()


def scene_with_model(scene: DataFrame, model: DataFrame, move: tuple[float, float, float] | None = None, quaternion: tuple[float, float, float, float] | None = None, seed: int = 0) -> tuple[DataFrame, rigid.Rigid]:
    """(the scene with the model's points turned about the model's centroid and put at the scene's centroid
    plus move, the transform). Points of the model have `added` true. Without move or quaternion: random."""
    move, q = move or random_move(seed), quaternion or random_quaternion(seed)
    at = [scene.agg(*[F.avg(a).alias(a) for a in "xyz"]).first(), model.agg(*[F.avg(a).alias(a) for a in "xyz"]).first()]
    r = rigid.from_quaternion(tuple(F.lit(float(x)) for x in q))
    center = V.literal(*[at[1][a] for a in "xyz"])
    to = V.literal(*[at[0][a] + m for a, m in zip("xyz", move)])
    t = (r, V.sub(to, rigid.turn(r, center)))
    keep = ["cloud_id", "pt_id", *FIELDS]
    put = transformed(model, t).select(*keep).withColumn("added", F.lit(True))
    return scene.select(*keep).withColumn("added", F.lit(False)).unionByName(put), t


__all__ = ["random_move", "random_quaternion", "scene_with_model", "centroids"]
