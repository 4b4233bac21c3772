"""Running sums over a whole table in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import lookup
from .tables import stored


def running_sums(rows: DataFrame, order: list[str | Column], sums: dict[str, Column], before: bool = False) -> DataFrame:
    """rows with a column for each of `sums`: its sum over all rows up to each one in order (before: without that one).

    Rows are sorted by ranges of the order and stored with their place, so that equal parts of them, whatever values are
    frequent, are summed on their own; a row for each part is what is summed up in one place.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    own = {f"__{n}": c for n, c in sums.items()}
    at = F.monotonically_increasing_id()
    held = rows.withColumns(own).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)
    held = stored(held.withColumn("__part", F.shiftright("__at", 33)))
    totals = held.groupBy("__part").agg(*[F.sum(n).alias(n) for n in own])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_start") for n in own])
    upto = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = held.withColumns({n: F.coalesce(F.sum(n).over(upto), F.lit(0)) for n in own})
    out = lookup(out, starts, ["__part"])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(f"__{n}") + F.col(f"__{n}_start")).alias(n) for n in sums])
