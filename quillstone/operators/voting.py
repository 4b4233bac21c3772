"""Votes of scene pairs for model pairs of the same bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions.vectors import pack_vote, unpack_vote
from .joins import SMALL_ROWS, lookup
from .pairs import KEYS
from .tables import stored

PAIR = ["scene_id", "model_id"]
#: Pairs of a bin that one task joins with as many of the other side, about.
BIN_ROWS = 2_000


def candidates(scene: DataFrame, model: DataFrame, on: list[str] | None = None, exact: bool = False, more: tuple[list[str], list[str]] = ((), ()), condition: Column | None = None) -> DataFrame:
    """scene_id, model_id, s_r, m_r, alpha: an equi-join on bins (and on model_id, if scene holds it as its
    bins go by the model's distance step). scene: scene_id, r, KEYS, a; model: model_id, r, KEYS, a. exact: also
    turn, the angle that alpha is the bin of, and s_i, m_i, the pairs' other points (column i of either side).
    condition: what must hold besides, of the columns `more` of the scene and of the model.

    Model pairs are broadcast after a count of SMALL_ROWS at most, so that scene pairs stay where they are made.
    More are joined by bin, and bins with many pairs are split on both sides (see _split()).
    """
    on = on or [*(["model_id"] if "model_id" in scene.columns else []), *KEYS]
    i = (lambda p: [F.col("i").alias(f"{p}_i")]) if exact else (lambda p: [])
    s = scene.select("scene_id", *on, F.col("r").alias("s_r"), F.col("a").alias("s_a"), *more[0], *i("s"))
    m = model.select(*dict.fromkeys(["model_id", *on]), F.col("r").alias("m_r"), F.col("a").alias("m_a"), *more[1], *i("m"))
    if m.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        met = s.join(F.broadcast(m), on)
    else:
        s, m, parts = _split(s, m, on)
        met = s.join(m, [*on, *parts])
    return met_candidates(met if condition is None else met.filter(condition), exact)


def met_candidates(met: DataFrame, exact: bool = False) -> DataFrame:
    """As candidates() gives them; met: pairs of scene and model that have met, with s_r, s_a, m_r, m_a (exact: s_i, m_i)."""
    turn = features.wrap(F.col("s_a") - F.col("m_a"))
    more = [turn.alias("turn"), "s_i", "m_i"] if exact else []
    return met.select(*PAIR, "s_r", "m_r", features.alpha_bin(F.col("s_a"), F.col("m_a")).alias("alpha"), *more)


def _split(s: DataFrame, m: DataFrame, on: list[str], most: int = BIN_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """s and m with columns that cut the rows of large bins into pieces of about `most`; each piece of the one
    side meets each piece of the other, so that a hot bin spreads over many tasks. The large bins, few of them, are
    stored: pairs are made once to count them, and once to meet."""
    pieces = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    heavy = stored(pieces(s, "__s").join(pieces(m, "__m"), on).filter("__s > 1 OR __m > 1"))
    own = lambda ref, name: F.coalesce(F.pmod(F.xxhash64(ref), F.col(name)).cast("int"), F.lit(0))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1))
    s, m = lookup(s, heavy, on, "left"), lookup(m, heavy, on, "left")
    s = s.withColumn("__a", own("s_a", "__s")).withColumn("__b", every("__m")).drop("__s", "__m")
    m = m.withColumn("__b", own("m_a", "__m")).withColumn("__a", every("__s")).drop("__s", "__m")
    return s, m, ["__a", "__b"]


def last_turns(found: DataFrame) -> DataFrame:
    """PAIR, s_r, m_r, alpha, turn: for each cell of votes the exact angle of its last candidate, in the order of
    scene points and then of model points. found: as candidates() gives them with exact."""
    return found.groupBy(*PAIR, "s_r", "m_r", "alpha").agg(F.max_by("turn", F.struct("s_i", "m_i")).alias("turn"))


def turn_histogram(found: DataFrame, edges: int = 100) -> DataFrame:
    """PAIR, edge (from 1), n: exact angles by the last of `edges` even marks from -pi to pi that isn't above them."""
    step = 2 * math.pi / (edges - 1)
    edge = F.least(F.floor((F.col("turn") + math.pi) / step) + 1, F.lit(edges)).alias("edge")
    return found.groupBy(*PAIR, edge).agg(F.count("*").alias("n"))


def votes(found: DataFrame) -> DataFrame:
    """PAIR, s_r, m_r, alpha, cnt, vote_code."""
    out = found.groupBy(*PAIR, "s_r", "m_r", "alpha").agg(F.count("*").alias("cnt"))
    return out.withColumn("vote_code", pack_vote(F.col("s_r"), F.col("m_r"), F.col("alpha")))


def unpacked(codes: DataFrame, code: str = "vote_code") -> DataFrame:
    s, m, a = unpack_vote(F.col(code))
    return codes.withColumns({"s_r": s, "m_r": m, "alpha": a})


def strongest(found: DataFrame) -> DataFrame:
    return found.groupBy(*PAIR).agg(F.max("cnt").alias("top"))


def pruned(found: DataFrame, threshold: float) -> DataFrame:
    """Votes of more than threshold times the strongest one of their scene and model. The strongest come
    from an aggregation and a lookup: a window would bring all votes of a pair into one task."""
    return lookup(found, strongest(found), PAIR).filter(F.col("cnt") > threshold * F.col("top")).drop("top")


def kept_counts(found: DataFrame, threshold: float, n: str | None = None) -> DataFrame:
    """PAIR, n_votes, n_kept. n: column of how many votes a row stands for."""
    rows = lookup(found, strongest(found), PAIR)
    kept, n = F.col("cnt") > threshold * F.col("top"), F.lit(1).cast("long") if n is None else F.col(n)
    return rows.groupBy(*PAIR).agg(F.sum(n).alias("n_votes"), F.sum(F.when(kept, n).otherwise(0)).alias("n_kept"))


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The `most` strongest votes of each scene and model, with rank; equal counts go by vote_code. Tasks keep
    their own `most` before rows are shuffled."""
    w = Window.partitionBy(*PAIR).orderBy(F.col("cnt").desc(), F.col("vote_code"))
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most)


def weighted(found: DataFrame, weights: DataFrame) -> DataFrame:
    """votes with weight (1 where weights has no row of model_id, m_r) and w_cnt."""
    out = lookup(found, weights.select("model_id", "m_r", "weight"), ["model_id", "m_r"], "left")
    out = out.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return out.withColumn("w_cnt", F.col("weight") * F.col("cnt"))


def best_by_scene_point(found: DataFrame, *more: str) -> DataFrame:
    """PAIR, s_r, m_r, alpha, cnt, and the columns `more`, of the strongest vote of each scene point; the least alpha, then the least
    m_r of equal ones."""
    top = F.max_by(F.struct("m_r", "alpha", "cnt", *more), F.struct("cnt", -F.col("alpha"), -F.col("m_r")))
    return found.groupBy(*PAIR, "s_r").agg(top.alias("t")).select(*PAIR, "s_r", "t.*")


def strong_scene_points(best: DataFrame, share: float = 0.9) -> DataFrame:
    """Those whose count is over share times the largest of their scene and model."""
    return lookup(best, strongest(best), PAIR).withColumn("share", F.col("cnt") / F.col("top")).filter(F.col("share") > share).drop("top")


def alpha_histogram(found: DataFrame) -> DataFrame:
    """PAIR, alpha, n: candidates by bin of alpha."""
    return found.groupBy(*PAIR, "alpha").agg(F.sum("cnt").alias("n"))
