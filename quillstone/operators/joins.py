"""Joins with a side that is small most of the time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast after it was counted.
SMALL_ROWS = 100_000


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = SMALL_ROWS, salts: int = 32) -> DataFrame:
    """left join right on equal columns. right is broadcast if its rows, counted up to limit, are within it;
    else it is repeated under `salts` salts, so that a key with a large part of left spreads over tasks."""
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    salt = "__salt"
    a = left.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    b = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, salt], how).drop(salt)
