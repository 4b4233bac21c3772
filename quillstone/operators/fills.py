"""Values carried forward along rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import lookup

#: Span of the order's numbers that one task fills.
SPAN = 1_000_000


def last_known(rows: DataFrame, value: Column, key: str, order: str, name: str, span: int = SPAN) -> DataFrame:
    """rows with `name`: the last value that isn't null up to each row of its key, in the order of a whole number.

    Spans of numbers are filled on their own. What a span doesn't know itself comes from the last span before it that
    knows a value: one row for each span is all that is brought together of a key.
    """
    rows = rows.withColumn("__value", value).withColumn("__span", F.floor(F.col(order) / span))
    known = rows.groupBy(key, "__span").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__last"))
    before = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carry = known.select(key, "__span", F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    own = Window.partitionBy(key, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("__own", F.last("__value", ignorenulls=True).over(own))
    out = lookup(out, carry, [key, "__span"], "left")
    return out.withColumn(name, F.coalesce("__own", "__carry")).drop("__value", "__span", "__own", "__last", "__carry")
