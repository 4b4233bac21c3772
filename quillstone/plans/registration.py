"""From scenes and models to the best pose of each model in each scene."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features
from ..operators import blocks, clouds, pairs, poses, voting
from ..operators.joins import lookup
from ..operators.tables import stored


@dataclass
class Options:
    """Of a registration; the defaults are the production path's."""

    tau: float | dict = 0.05  # distance step over the model's extent; or one by model_id
    scene_leaf: float | None = None  # voxel size of scenes; None: as they are
    thin_models: bool = False  # models are put on a voxel grid of their own distance step
    ref_factor: int = 1  # every so many-th scene point is a reference point
    vote_threshold: float = 0.4  # of the strongest vote
    greedy: bool = False  # clusters by falling votes in place of neighbouring cells; the one of most votes answers
    any_distance: bool = False  # rotations alone make neighbours
    averaged: bool = False  # the answer's translation is its neighbours' mean
    own_cell: bool = False
    own_weight: bool = False


def model_steps(models: DataFrame, tau: float | dict) -> DataFrame:
    """model_id, d_dist, diam: the distance step and extent of each model; as many rows as models. tau: a number,
    or a dict of model_id to number; models that it lacks have no step and aren't registered."""
    out = clouds.extents(models).select(F.col("cloud_id").alias("model_id"), F.col("extent").alias("diam"))
    if isinstance(tau, dict):
        kind = models.schema["cloud_id"].dataType.simpleString()
        taus = models.sparkSession.createDataFrame(list(tau.items()), f"model_id {kind}, tau double")
        return lookup(out, taus, ["model_id"]).select("model_id", (F.col("tau") * F.col("diam")).alias("d_dist"), "diam")
    return out.select("model_id", (tau * F.col("diam")).alias("d_dist"), "diam")


def _numbered_by_place(points: DataFrame) -> DataFrame:
    """pt_id from 0 in each cloud, so that it fits its bits of a vote code."""
    mixed = points.withColumn("pt_id", F.xxhash64("x", "y", "z"))
    return clouds.numbered(mixed, span=1 << 58).withColumn("pt_id", F.col("position")).drop("position")


def _thinned(points: DataFrame, leaf) -> DataFrame:
    """The points' means by cell; leaf: a number or a column that each cloud has one value of."""
    cell = [F.floor(F.col(a) / leaf).alias(f"c{k}") for k, a in enumerate(clouds.POINT)]
    means = [F.avg(f).alias(f) for f in clouds.FIELDS]
    return _numbered_by_place(clouds.finite(points).groupBy("cloud_id", *cell).agg(*means).drop("c0", "c1", "c2"))


def stored_bins(models: DataFrame, steps: DataFrame) -> DataFrame:
    """binned_models() with d_dist, made in the tasks: votes made there of such pairs compare angles of one library."""
    steps = steps.select(F.col("model_id").alias("cloud_id"), "d_dist")
    return lookup(blocks.binned(lookup(models, steps, ["cloud_id"])), steps, ["cloud_id"]).withColumnRenamed("cloud_id", "model_id")


def binned_models(models: DataFrame, steps: DataFrame) -> DataFrame:
    """model_id, r, i, a, KEYS of all models; their points take the step along, not their pairs."""
    points = lookup(models, steps.select(F.col("model_id").alias("cloud_id"), "d_dist"), ["cloud_id"])
    out = pairs.angle_bins(pairs.point_pair_features(points, keep=("d_dist",)))
    return pairs.distance_bin(out, F.col("d_dist")).withColumnRenamed("cloud_id", "model_id")


#: What a pair of a scene and one of a model meet by: a class of distance steps, a cell of distances, the angles' bins.
MEET = ["octave", "c1", "k2", "k3", "k4"]


def _octave() -> Column:
    return F.floor(F.log2("d_dist"))


def step_classes(steps: DataFrame) -> list[tuple[int, float]]:
    """(octave, the least step in it) of the models' distance steps: as many as there are octaves, 2,100 at most."""
    rows = steps.filter("d_dist > 0").groupBy(_octave().alias("octave")).agg(F.min("d_dist").alias("w")).collect()
    return sorted((r["octave"], r["w"]) for r in rows)


def scene_cells(scenes: DataFrame, classes: list[tuple[int, float]], ref_factor: int = 1, made=pairs.point_pair_features) -> DataFrame:
    """scene_id, r, i, a, f1, MEET of all scene pairs: a row for each class of steps, not for each model. Cells of a class
    are as wide as its least step. made: what makes the pairs' features."""
    ppf = pairs.angle_bins(made(scenes, ref_factor)).withColumnRenamed("cloud_id", "scene_id")
    if not classes:
        return ppf.limit(0).withColumns({"octave": F.lit(0).cast("long"), "c1": F.lit(0).cast("long")})
    every = F.array(*[F.struct(F.lit(o).cast("long").alias("octave"), F.lit(w).alias("w")) for o, w in classes])
    out = ppf.select("*", F.explode(every).alias("__class")).withColumns({"octave": F.col("__class.octave"), "__w": F.col("__class.w")})
    return out.withColumn("c1", features.bin_of(F.col("f1"), F.col("__w"))).dropna(subset=["c1"]).drop("__class", "__w")


def model_cells(models: DataFrame, steps: DataFrame, classes: list[tuple[int, float]], made=binned_models) -> DataFrame:
    """model_id, r, i, a, KEYS, d_dist, octave, c1 of all model pairs, a row for each cell (three at most, one if all
    steps of the class are equal) that its bin of distances touches."""
    widths = F.create_map(*[x for o, w in classes for x in (F.lit(o).cast("long"), F.lit(w))]) if classes else F.create_map(F.lit(0).cast("long"), F.lit(1.0))
    out = made(models, steps.filter("d_dist > 0")).withColumn("octave", _octave())
    w, edge = F.try_element_at(widths, F.col("octave")), lambda k, slack: F.floor(k * F.col("d_dist") * slack / w)
    cells = F.when(F.col("d_dist") == w, F.array("k1")).otherwise(F.sequence(edge(F.col("k1"), 1 - 1e-9), edge(F.col("k1") + 1, 1 + 1e-9)))
    return out.withColumn("c1", F.explode(cells))


def same_bin() -> Column:
    """Whether the distance of a scene pair lies in the model pair's own bin."""
    return features.bin_of(F.col("f1"), F.col("d_dist")) == F.col("k1")


def found_candidates(scenes: DataFrame, models: DataFrame, steps: DataFrame, ref_factor: int = 1, exact: bool = False) -> DataFrame:
    """Candidates of all scenes for all models. A scene pair isn't repeated for each model: it meets model pairs by
    cells of distances that models of about one step share, and its bin is tested by the model's own step when they meet."""
    classes = step_classes(steps)
    s, m = scene_cells(scenes, classes, ref_factor), model_cells(models, steps, classes)
    return voting.candidates(s, m, MEET, exact, (["f1"], ["d_dist", "k1"]), same_bin())


def found_votes(scenes: DataFrame, models: DataFrame, steps: DataFrame, ref_factor: int = 1, exact: bool = False, threshold: float = 0.0, give: tuple | None = None) -> DataFrame:
    """Votes of all scenes for all models, counted in the tasks that make the pairs: candidates are never rows. exact: with turn, as
    voting.last_turns() gives it. threshold: for voting.pruned(), votes that it drops for certain may be left out. give: see blocks.votes()."""
    out = blocks.votes(scenes, models, steps, ref_factor, exact, threshold, give=give)
    if "s_r" not in out.columns:
        return out
    return out.withColumn("vote_code", voting.pack_vote(F.col("s_r"), F.col("m_r"), F.col("alpha")))


def vote_poses(votes: DataFrame, scenes: DataFrame, models: DataFrame, steps: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Poses of votes with their quaternion, cell and weight."""
    rows = votes.withColumn("w_cnt", F.col("cnt").cast("double")) if weights is None else voting.weighted(votes, weights).drop("weight")
    out = poses.decomposed(poses.of_votes(rows, scenes, models))
    out = lookup(out, steps.select("model_id", "d_dist"), ["model_id"])
    return stored(poses.cells(out, F.col("d_dist")))  # clusters join them with themselves


def register(scenes: DataFrame, models: DataFrame, options: Options = Options(), weights: DataFrame | None = None) -> DataFrame:
    """scene_id, model_id, score, t11 ... t34 for each scene and model that share a vote.

    scenes, models: clouds (cloud_id, pt_id, x, y, z, nx, ny, nz). weights: model_id, m_r, weight.
    """
    if options.scene_leaf:
        scenes = _thinned(scenes, options.scene_leaf)
    steps = model_steps(models, options.tau)
    if options.thin_models:
        at = lookup(models, steps.select(F.col("model_id").alias("cloud_id"), "d_dist"), ["cloud_id"])
        models = _thinned(at, F.col("d_dist"))
    return answers(found_votes(scenes, models, steps, options.ref_factor, threshold=options.vote_threshold), scenes, models, steps, options, weights)


def answers(votes: DataFrame, scenes: DataFrame, models: DataFrame, steps: DataFrame, options: Options = Options(), weights: DataFrame | None = None) -> DataFrame:
    """scene_id, model_id, score, t11 ... t34: the best pose by all votes of each scene and model."""
    made = vote_poses(voting.pruned(stored(votes), options.vote_threshold), scenes, models, steps, weights)
    if options.greedy:
        best = poses.cluster_poses(poses.greedy_clusters(made).filter("rank = 1"))
    else:
        scored = poses.neighbour_scores(made, None, options.own_cell, options.any_distance, options.own_weight)
        best = poses.best(scored, options.averaged)
    return best.select("scene_id", "model_id", "score", *[c for c in best.columns if c in _MATRIX])


_MATRIX = {f"t{r}{c}" for r in range(1, 4) for c in range(1, 5)}


@dataclass
class PointVotes:
    """What voting by scene points gives."""

    accumulator: DataFrame  # PAIR, s_r, m_r, alpha, cnt: all cells
    best: DataFrame  # PAIR, s_r, m_r, alpha, cnt, share (of the largest count): the strongest cell of each scene point
    top: DataFrame  # PAIR, top: the largest count
    transforms: DataFrame  # of best with share over the limit: turn and the transforms m_t11 ..., s_t11 ..., a_t11 ...


def describe_model(model: DataFrame, factor: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(index: model_id, KEYS, pairs; steps: model_id, d_dist, diam): a model's pairs by bin, the distance step
    being `factor` times the radius."""
    steps = clouds.radii(model, factor=factor).select(F.col("cloud_id").alias("model_id"), "d_dist", (2 * F.col("radius")).alias("diam"))
    return pairs.inverted_index(binned_models(model, steps), ["model_id", *pairs.KEYS]), steps


def vote_by_points(scene: DataFrame, model: DataFrame, steps: DataFrame, skip: int = 5, share: float = 0.9) -> PointVotes:
    """Votes of every skip-th scene point; those whose strongest cell reaches `share` of the largest count give
    the model's frame, the scene's frame and the turn of the cell's last candidate, unquantised."""
    best = found_votes(clouds.finite(scene), model, steps, skip, exact=True, give=blocks.VOTES_GIVEN["best"])
    best = stored(voting.best_by_scene_point(best, "turn"))
    kept = voting.strong_scene_points(best, share).select(*voting.PAIR, "s_r", "m_r", "alpha", "turn")
    best = best.drop("turn")
    return PointVotes(found_votes(clouds.finite(scene), model, steps, skip).drop("vote_code"), best, voting.strongest(best), poses.three_transforms(kept, scene, model))
