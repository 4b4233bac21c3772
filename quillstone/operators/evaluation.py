"""Recognition rates and errors against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rigid import fold_angle
from .joins import lookup
from .medians import medians
from .runs import running_sums
from .tables import stored

# Diameters of the models of the evaluation.
MODEL_DIAMETERS = {"chef": 136.59418, "trex": 98.828925, "para": 131.250275, "chicken": 86.28052}
#: Twelve degrees, as the evaluation rounds them.
TWELVE_DEGREES = 0.209440


def diameters(spark) -> DataFrame:
    return spark.createDataFrame(list(MODEL_DIAMETERS.items()), "model string, diam double")


def joined(occlusion: DataFrame, distances: DataFrame) -> DataFrame:
    """occlusion (scene_num, model, occlusion) with trans and rot; pairs without a distance have nulls.
    Of several distances of a pair, the first (by file, then line) counts."""
    first = distances.groupBy("scene_num", "model").agg(F.min_by(F.struct("trans", "rot"), F.struct("file", "line_no")).alias("d"))
    return occlusion.join(first, ["scene_num", "model"], "left").select("scene_num", "model", "occlusion", "d.trans", "d.rot")


def flagged(rows: DataFrame, sizes: DataFrame, factor: float = 0.3, rotation: float = TWELVE_DEGREES) -> DataFrame:
    """rows with norm_dist, rot_folded and match (both within their limits, which count as within)."""
    out = lookup(rows, sizes, ["model"], "left")
    match = F.coalesce((F.col("trans") <= factor * F.col("diam")) & (F.col("rot") <= rotation), F.lit(False))
    return out.select(*rows.columns, (F.col("trans") / F.nullif("diam", F.lit(0.0))).alias("norm_dist"), fold_angle(F.col("rot")).alias("rot_folded"), match.alias("match"))


def running_rate(rows: DataFrame, order: list[str], match: str = "match") -> DataFrame:
    """rows with rate, the share of matches among all rows up to each one in the given order (no ties)."""
    out = running_sums(rows, order, {"__rows": F.lit(1).cast("long"), "__hits": F.col(match).cast("long")})
    return out.withColumn("rate", F.col("__hits") / F.col("__rows")).select(*rows.columns, "rate")


def error_summary(rows: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """mean_ and median_ of each column; medians are found by passes over the rows (see medians())."""
    rows = stored(rows.select(*(keys or []), *columns))
    means = rows.groupBy(*(keys or [])).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    names = [f"{n}_{c}" for c in columns for n in ("mean", "median")]
    middle = medians(rows, columns, keys)
    out = lookup(means, middle, keys) if keys else means.crossJoin(middle)  # a row each
    return out.select(*(keys or []), *names)


def near_enough(rows: DataFrame, occlusion: float = 80.0, distance: float = 2.0) -> DataFrame:
    return rows.filter((F.col("occlusion") <= occlusion) & (F.col("norm_dist") <= distance))
