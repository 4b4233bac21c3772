"""Point clouds: rows of cloud_id, pt_id, x, y, z, nx, ny, nz. Sampling, extents, moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.features import moved
from ..functions.rigid import Rigid
from .joins import lookup

POINT, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")
FIELDS = (*POINT, *NORMAL)
#: Span of pt_id whose points are numbered in one task.
SPAN = 100_000


def from_embeddings(embeddings: DataFrame) -> DataFrame:
    """The cloud that a table of vectors makes: a cloud for each label, a point and normal for each vector."""
    e = F.col("embedding")
    return embeddings.select(F.col("label").alias("cloud_id"), F.col("vec_id").alias("pt_id"), *[e[k].cast("double").alias(n) for k, n in enumerate(FIELDS)])


def finite(points: DataFrame, fields: tuple[str, ...] = POINT) -> DataFrame:
    out = points
    for f in fields:
        out = out.filter(F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(f) < float("inf")))
    return out


def cell(fields: tuple[str, ...], leaf: float | Column | tuple) -> list[Column]:
    leaves = leaf if isinstance(leaf, tuple) else (leaf,) * len(fields)
    return [F.floor(F.col(f) / s).alias(f"c{k}") for k, (f, s) in enumerate(zip(fields, leaves))]


def voxel_downsample(points: DataFrame, leaf: float | tuple, keys: tuple[str, ...] = ("cloud_id",), axes: tuple[str, ...] = POINT, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """keys, c0, c1, c2, the mean of each field, and n: a row for each cell of size leaf that holds points.
    Points that aren't finite go. Sums are partial in each task before they are shuffled."""
    means = [F.avg(f).alias(f) for f in fields]
    return finite(points, axes).groupBy(*keys, *cell(axes, leaf)).agg(*means, F.count("*").alias("n"))


def numbered(points: DataFrame, key: str = "cloud_id", order: str = "pt_id", span: int = SPAN) -> DataFrame:
    """points with position, from 0, in the order of pt_id in each cloud. Spans of pt_id are counted and
    numbered on their own, so that one large cloud isn't sorted in one task."""
    part = F.floor(F.col(order) / span).alias("__span")
    counts = points.groupBy(key, part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "__span", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(key, "__span").orderBy(order)
    rows = lookup(points.withColumn("__span", part), starts, [key, "__span"])
    return rows.withColumn("position", F.row_number().over(own) - 1 + F.col("__start")).drop("__span", "__start")


def every_nth(points: DataFrame, n: int, key: str = "cloud_id", order: str = "pt_id") -> DataFrame:
    return numbered(points, key, order).filter(F.col("position") % n == 0).drop("position")


def evenly_spaced(points: DataFrame, n: int, key: str = "cloud_id", order: str = "pt_id") -> DataFrame:
    """The points at n places from the first to the last, rounded down; a place that comes again gives one row."""
    sizes = points.groupBy(key).agg(F.count("*").alias("__size"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__k")
    at = F.floor(1 + F.col("__k") * (F.col("__size") - 1) / F.lit(max(1, n - 1))).cast("long") - 1
    places = sizes.select(key, "__size", k).select(key, at.alias("position")).distinct()
    return lookup(numbered(points, key, order), places, [key, "position"]).drop("position")


def reference_points(points: DataFrame, factor: int, order: str = "pt_id") -> DataFrame:
    """Those whose number is a multiple of factor; filtered before pairs are made of them."""
    return points.filter(F.pmod(F.col(order), F.lit(factor)) == 0)


def random_sample(points: DataFrame, share: float, seed: int = 0, key: str = "cloud_id") -> DataFrame:
    """Exactly floor(share * n) points of the n of each cloud: those of the least random numbers. Cut points
    are found by counting the numbers' leading bits, so that no cloud is sorted whole."""
    drawn = points.withColumn("__r", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in points.columns]))
    slot = F.shiftrightunsigned("__r", 48).alias("__slot")
    counts = drawn.groupBy(key, slot).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(key)
    counts = counts.select(key, "__slot", F.sum("__n").over(whole).alias("__all"), F.coalesce(F.sum("__n").over(whole.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = lookup(drawn.withColumn("__slot", slot), counts, [key, "__slot"])
    rank = F.row_number().over(Window.partitionBy(key, "__slot").orderBy("__r", *[F.col(f"`{c}`") for c in points.columns]))
    return rows.withColumn("__rank", rank + F.col("__before")).filter(F.col("__rank") <= F.floor(F.lit(share) * F.col("__all"))).select(*points.columns)


def extents(points: DataFrame, keys: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    """keys, min and max by axis, extent (the longest side), n."""
    bounds = [f(a).alias(f"{n}_{a}") for a in POINT for n, f in (("min", F.min), ("max", F.max))]
    out = points.groupBy(*keys).agg(*bounds, F.count("*").alias("n"))
    return out.withColumn("extent", F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in POINT]))


def radii(points: DataFrame, key: str = "cloud_id", factor: float = 0.1) -> DataFrame:
    """key, radius (the largest distance from the middle of the bounding box) and d_dist, factor times it."""
    box = extents(points, (key,)).select(key, *[((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"m{a}") for a in POINT])
    far = V.distance(V.vec(*POINT), V.vec("mx", "my", "mz"))
    out = lookup(points, box, [key]).groupBy(key).agg(F.max(far).alias("radius"))
    return out.withColumn("d_dist", factor * F.col("radius"))


def shift_to_positive(points: DataFrame, key: str = "cloud_id") -> DataFrame:
    """tx, ty, tz: over all clouds, the largest of 1 and the size of the least coordinate together."""
    low = points.groupBy(key).agg(*[F.min(a).alias(a) for a in POINT])
    return low.agg(*[F.greatest(F.lit(0.0), F.max(F.abs(a) + 1)).alias(f"t{a}") for a in POINT])


def centroids(points: DataFrame, keys: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    return points.groupBy(*keys).agg(*[F.avg(a).alias(f"m{a}") for a in POINT])


def centered(points: DataFrame, at: float = 0.0, key: str = "cloud_id") -> DataFrame:
    """Clouds moved so that their centroids lie at (at, at, at)."""
    rows = lookup(points, centroids(points, (key,)), [key])
    return rows.withColumns({a: F.col(a) - F.col(f"m{a}") + at for a in POINT}).drop("mx", "my", "mz")


def transformed(points: DataFrame, t: Rigid) -> DataFrame:
    """Points and normals under a rigid transform, given as literals or as columns of points."""
    p, n = moved(t, V.vec(*POINT), V.vec(*NORMAL))
    return points.select(*[dict(zip(FIELDS, (*p, *n))).get(c, F.col(f"`{c}`")).alias(c) for c in points.columns])


def sizes(points: DataFrame, keys: tuple[str, ...] = ("cloud_id",)) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("n"))
