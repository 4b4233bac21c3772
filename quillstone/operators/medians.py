"""Exact medians without a buffer of all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import lookup
from .tables import stored

#: Cuts by which a pass divides the values that are left of a group, and values that are few enough to be sorted.
CUTS, FEW = 63, 1_000
_FAR = 1.7976931348623157e308


def medians(rows: DataFrame, columns: list[str], keys: list[str] | None = None, cuts: int = CUTS, few: int = FEW) -> DataFrame:
    """keys and median_ of each column, exactly: the middle value, or the mean of the two in the middle.

    Each middle value is searched by its rank. A pass takes cuts near even shares of the values between the bounds that are left
    (a sketch of bounded size), and counts, exactly, the values at each cut and between cuts, partially in the tasks. Where the rank falls
    are the next bounds, with about 1 / cuts of the values. `few` values are sorted; no more of a group are ever
    together, however they are spread or repeated. Nulls and NaN don't count, infinite values count as the largest finite
    ones; a group without a value has null.
    """
    names = keys or ["__all"]
    key = [F.col(k) for k in keys] if keys else [F.lit(1).alias("__all")]
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)]))
    long = rows.select(*key, values.alias("x")).select(*names, "x.c", "x.v").filter("v IS NOT NULL AND NOT isnan(v)")
    long = stored(long.withColumn("v", F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), "v"))))
    own, search = [*names, "c"], [*names, "c", "rank"]
    ends = long.groupBy(*own).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.explode(F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))))
    state = stored(ends.select(*own, ranks.alias("rank"), "low", "high", "n", F.lit(0).cast("long").alias("below")))
    done = []
    while True:
        done.append(state.filter("low = high").select(*own, F.col("low").alias("v")))
        last = state.filter(F.expr("low < high") & (F.col("n") <= few))
        sorted_ = _inside(long, last, own).groupBy(*search, "below").agg(F.sort_array(F.collect_list("v")).alias("all"))
        done.append(sorted_.select(*own, F.element_at("all", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v")))
        state = state.filter(F.expr("low < high") & (F.col("n") > few))
        if state.isEmpty():
            break
        inside = _inside(long, state, own)
        at = F.percentile_approx("v", F.array(*[F.lit(k / (cuts + 1)) for k in range(1, cuts + 1)]), 1_000)
        inside = lookup(inside, stored(inside.groupBy(*search).agg(F.array_distinct(at).alias("cuts"))), search)
        bin_ = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        counts = inside.groupBy(*search, "below", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = Window.partitionBy(*search).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # of two rows for each cut
        counts = counts.withColumn("first", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        state = stored(counts.filter("rank >= first AND rank < first + n").select(*search, "low", "high", "n", F.col("first").alias("below")))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    middle = found.groupBy(*own).agg((F.min("v") / 2 + F.max("v") / 2).alias("m"))
    out = middle.groupBy(*names).agg(*[F.max(F.when(F.col("c") == k, F.col("m"))).alias(f"median_{c}") for k, c in enumerate(columns)])
    if keys:
        return lookup(rows.select(*keys).distinct(), out, keys, "left")
    one = rows.sparkSession.range(1).select(F.lit(1).alias("__all"))
    return one.join(out, "__all", "left").drop("__all")


def _inside(long: DataFrame, state: DataFrame, own: list[str]) -> DataFrame:
    """Values between the bounds of what is searched in their group: two searches at most."""
    held = state.groupBy(*own).agg(F.collect_list(F.struct("rank", "low", "high", "below")).alias("b"))
    return lookup(long, held, own).select(*own, "v", F.explode("b").alias("b")).select(*own, "v", "b.*").filter("v >= low AND v <= high")
