"""Triangles of polygons, and normals of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .joins import lookup


def fan_triangles(faces: DataFrame, indices: str = "vertex_indices", base: int = 0) -> DataFrame:
    """cloud_id, face_id, part, v1, v2, v3: (first, k-th, next) of each polygon; base is added to each index."""
    f = F.col(indices)
    parts = faces.filter(F.size(f) >= 3).select("cloud_id", "face_id", f.alias("f"), F.explode(F.sequence(F.lit(2), F.size(f) - 1)).alias("k"))
    at = lambda k: F.element_at("f", k).cast("long") + base
    return parts.select("cloud_id", "face_id", (F.col("k") - 1).cast("long").alias("part"), at(F.lit(1)).alias("v1"), at(F.col("k")).alias("v2"), at(F.col("k") + 1).alias("v3"))


def vertex_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """cloud_id, pt_id, nx, ny, nz: the mean of the incident triangles' unit normals, made a unit again.
    Triangles without an area have none. triangles: cloud_id, v1, v2, v3; vertices: cloud_id, pt_id, x, y, z."""
    rows = triangles
    for k in (1, 2, 3):
        corner = vertices.select("cloud_id", F.col("pt_id").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
        rows = lookup(rows, corner, ["cloud_id", f"v{k}"])
    p = [V.vec(f"x{k}", f"y{k}", f"z{k}") for k in (1, 2, 3)]
    n = V.cross(V.sub(p[1], p[0]), V.sub(p[2], p[0]))
    size = V.norm(n)
    rows = rows.select("cloud_id", F.explode(F.array("v1", "v2", "v3")).alias("pt_id"), *[V.ratio(c, size).alias(a) for c, a in zip(n, ("nx", "ny", "nz"))]).dropna()
    sums = rows.groupBy("cloud_id", "pt_id").agg(*[F.sum(a).alias(a) for a in ("nx", "ny", "nz")])
    s = V.vec("nx", "ny", "nz")
    return sums.select("cloud_id", "pt_id", *[V.ratio(c, V.norm(s)).alias(a) for c, a in zip(s, ("nx", "ny", "nz"))])
