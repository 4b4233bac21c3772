"""Poses of votes, their cells, clusters of neighbouring poses, and the best pose."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features, rigid
from ..functions import vectors as V
from . import nearby
from .clouds import FIELDS, NORMAL, POINT
from .joins import lookup
from .tables import stored
from .voting import PAIR

QUATERNION, MOVE, CELL = ["qw", "qx", "qy", "qz"], ["tx", "ty", "tz"], ["cx", "cy", "cz"]
#: Angle within which rotations of one cluster lie.
ROTATION_STEP = 2 * features.D_ANGLE


def _points(points: DataFrame, id_name: str, ref: str, prefix: str) -> DataFrame:
    return points.select(F.col("cloud_id").alias(id_name), F.col("pt_id").alias(ref), *[F.col(c).alias(prefix + c) for c in FIELDS])


def with_points(votes: DataFrame, scene: DataFrame, model: DataFrame, scene_key: bool = True) -> DataFrame:
    """votes with their reference points and normals. scene_key: scene points are found by scene_id too."""
    s = _points(scene, "scene_id", "s_r", "s_")
    out = lookup(votes, s if scene_key else s.drop("scene_id"), ["scene_id", "s_r"] if scene_key else ["s_r"])
    return lookup(out, _points(model, "model_id", "m_r", "m_"), ["model_id", "m_r"])


def _frame_stages(df: DataFrame, p: str) -> DataFrame:
    """df with {p}f0 ... {p}f8, the rotation that brings the normal {p}nx, ... onto the x axis. Each stage is a
    projection of its own: written out in one expression, terms would be repeated many times over."""
    n = [F.col(p + c) for c in NORMAL]
    df = df.withColumn(p + "yaw", F.atan2(n[2], n[0])).withColumns({p + "cy": F.cos(p + "yaw"), p + "sy": F.sin(p + "yaw")})
    df = df.withColumn(p + "tilt", -F.atan2(n[1], F.col(p + "cy") * n[0] + F.col(p + "sy") * n[2]))
    df = df.withColumns({p + "cz": F.cos(p + "tilt"), p + "sz": F.sin(p + "tilt")})
    cy, sy, cz, sz = (F.col(p + c) for c in ("cy", "sy", "cz", "sz"))
    return df.withColumns({f"{p}f{k}": c for k, c in enumerate((cz * cy, -sz, cz * sy, sz * cy, cz, sz * sy, -sy, F.lit(0.0), cy))})


def of_votes(votes: DataFrame, scene: DataFrame, model: DataFrame, scene_key: bool = True) -> DataFrame:
    """votes with t11 ... t34, the transform from the model to the scene: the model's frame, the turn by the
    lower edge of the vote's bin, and the inverse of the scene's frame."""
    df = _frame_stages(_frame_stages(with_points(votes, scene, model, scene_key), "s_"), "m_")
    df = df.withColumn("g", features.bin_angle(F.col("alpha")))
    nine = lambda p: tuple(F.col(f"{p}{k}") for k in range(9))
    df = df.withColumns({"gc": F.cos("g"), "gs": F.sin("g")})
    m = rigid.rows(nine("m_f"))
    c, s = F.col("gc"), F.col("gs")
    turned = (*m[0], *(c * a - s * b for a, b in zip(m[1], m[2])), *(s * a + c * b for a, b in zip(m[1], m[2])))
    df = df.withColumns({f"b{k}": x for k, x in enumerate(turned)})
    df = df.withColumns({f"r{k}": x for k, x in enumerate(rigid.multiply(rigid.transpose(nine("s_f")), nine("b")))})
    r = nine("r")
    t = r, V.sub(V.vec(*["s_" + a for a in POINT]), rigid.turn(r, V.vec(*["m_" + a for a in POINT])))
    return df.select(*[F.col(x) for x in votes.columns], *[x.alias(n) for n, x in rigid.to_columns(t).items()])


def decomposed(poses: DataFrame) -> DataFrame:
    """poses with the quaternion (qw, qx, qy, qz) and the translation (tx, ty, tz)."""
    m, v = rigid.from_columns()
    return poses.withColumns({**dict(zip(QUATERNION, rigid.to_quaternion(m))), **dict(zip(MOVE, v))})


def cells(poses: DataFrame, d_dist, truncate: bool = False) -> DataFrame:
    """poses with the cell of their translation; truncate: toward 0, which makes the cells there wider."""
    f = (lambda c: (c / d_dist).cast("long")) if truncate else (lambda c: F.floor(c / d_dist))
    return poses.withColumns({c: f(F.col(t)) for c, t in zip(CELL, MOVE)})


def neighbour_scores(poses: DataFrame, d_dist, own_cell: bool = False, any_distance: bool = False, own_weight: bool = False, most: int = nearby.OWN) -> DataFrame:
    """poses with score and the mean translation ax, ay, az.

    A pose's score is 1 (own_weight: its own weight) and the weights w_cnt of the poses in the 26 cells
    around its own (own_cell: in 27) whose rotation is near and, unless any_distance, whose translation lies
    within d_dist. Poses meet in blocks of cells (see nearby), `most` own ones of a block in a task, and are summed up where they meet.
    """
    rows = poses.withColumn("__reach", F.col("d_dist") if "d_dist" in poses.columns else F.lit(d_dist).cast("double"))

    def start(mine: dict):
        sums = np.zeros((4, len(mine["w_cnt"])))

        def met(a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> None:
            near = np.abs(8 * (1 - _product(a, i, b, j))) < ROTATION_STEP**2
            if not any_distance:
                near &= _apart(a, i, b, j) < a["__reach"][i]
            if own_cell:
                near &= a["vote_code"][i] != b["vote_code"][j]
            i, j = i[near], j[near]
            for k, x in enumerate((1.0, *[b[c][j] for c in MOVE])):
                np.add.at(sums[k], i, b["w_cnt"][j] * x)

        return met, lambda: list(sums)

    made = ", ".join(f"__{c} double" for c in ("w", *MOVE))
    columns = ["vote_code", *QUATERNION, *MOVE, "w_cnt", "__reach"]
    out = nearby.meet(rows, rows, PAIR, CELL, "vote_code", QUATERNION, columns, 1 - ROTATION_STEP**2 / 8 - 1e-9, made, start, True, own_cell, most=most)
    base = F.col("w_cnt") if own_weight else F.lit(1.0)
    mean = {f"a{c[1]}": (base * F.col(c) + F.col("__" + c)) / (base + F.col("__w")) for c in MOVE}
    return out.withColumns({"score": base + F.col("__w"), **mean}).drop("__w", "__reach", *["__" + c for c in MOVE])


def _product(a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
    w, x, y, z = (a[c][i] * b[c][j] for c in QUATERNION)
    return w + x + y + z


def _apart(a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> np.ndarray:
    x, y, z = (a[c][i] - b[c][j] for c in MOVE)
    return np.sqrt(x * x + y * y + z * z)


def best(scored: DataFrame, averaged: bool = False) -> DataFrame:
    """The pose of the highest score for each scene and model; ties by count, then by the lesser vote_code.
    averaged: its translation is the mean of its neighbours'."""
    fields = [c for c in scored.columns if c not in PAIR]
    order = F.struct(F.col("score"), F.col("cnt"), -F.col("vote_code"))
    out = scored.groupBy(*PAIR).agg(F.max_by(F.struct(*fields), order).alias("b")).select(*PAIR, "b.*")
    return out.withColumns({"t14": F.col("ax"), "t24": F.col("ay"), "t34": F.col("az")}) if averaged else out


_BOX = ["b0", "b1", "b2"]


def _strongest_near(poses: DataFrame, others: DataFrame, rotation: float, stronger: bool = False) -> DataFrame:
    """poses with n_code, n_cnt and n_qw ... of the strongest of the others that is near (stronger: and stronger than the pose); null where
    there is none."""

    def start(mine: dict):
        n = len(mine["cnt"])
        top, code, turn = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros((4, n))

        def met(a: dict, i: np.ndarray, b: dict, j: np.ndarray) -> None:
            near = (_apart(a, i, b, j) < a["d_dist"][i]) & (2 * np.arccos(np.minimum(1.0, np.abs(_product(a, i, b, j)))) < rotation)
            near |= a["vote_code"][i] == b["vote_code"][j]
            if stronger:
                near &= (b["cnt"][j] > a["cnt"][i]) | ((b["cnt"][j] == a["cnt"][i]) & (b["vote_code"][j] < a["vote_code"][i]))
            i, j = i[near], j[near]
            by = np.lexsort((b["vote_code"][j], -b["cnt"][j], i))
            i, j = i[by], j[by]
            if len(i):
                one = np.append(True, i[1:] != i[:-1])
                i, j = i[one], j[one]
                more = (b["cnt"][j] > top[i]) | ((b["cnt"][j] == top[i]) & (b["vote_code"][j] < code[i]))
                i, j = i[more], j[more]
                top[i], code[i] = b["cnt"][j], b["vote_code"][j]
                for k, c in enumerate(QUATERNION):
                    turn[k][i] = b[c][j]

        return met, lambda: [pa.array(x, mask=top < 0) for x in (code, top, *turn)]

    made = ", ".join(["n_code long", "n_cnt long", *[f"n_{c} double" for c in QUATERNION]])
    columns = ["vote_code", "cnt", *QUATERNION, *MOVE, "d_dist"]
    return nearby.meet(poses, others, PAIR, _BOX, "vote_code", QUATERNION, columns, math.cos(rotation / 2) - 1e-9, made, start)


def greedy_seeds(poses: DataFrame, rotation: float) -> DataFrame:
    """The poses that, taken by falling count, are near no seed before them; poses: with d_dist and boxes of that size.

    A round finds all poses that no stronger undecided one is near: they are seeds, whatever the rest will be. What is near them is
    decided with them. Rounds go on with the rest until there is none: the seeds are those of the order one by one.
    """
    left, found = poses, None
    while True:
        new = stored(_strongest_near(left, left, rotation, True).filter("n_code IS NULL").select(*poses.columns))
        found = new if found is None else found.unionByName(new)
        left = stored(_strongest_near(left, new, rotation).filter("n_code IS NULL").select(*poses.columns))
        if left.isEmpty():
            return found


def greedy_clusters(poses: DataFrame, d_dist: float | None = None, rotation: float = features.D_ANGLE, keep: int = 3) -> DataFrame:
    """PAIR, rank, votes, n_poses, tx ... qz: poses taken by falling count join the first cluster whose seed
    is near, or make a new one; the `keep` clusters of most votes, with mean translation and rotation. d_dist:
    how far translations of a cluster may lie from its seed's; None: poses' column d_dist, the model's step.

    Seeds are found in rounds (greedy_seeds()); each pose then joins the strongest seed near it, as a weaker one would have
    come later. Poses meet by boxes, so no scene and model is one group. A cluster's quaternions are turned to its
    seed's side before they are averaged. Poses that aren't finite are near none.
    """
    reach = F.col("d_dist") if d_dist is None else F.lit(float(d_dist))
    rows = poses.select(*PAIR, "cnt", "vote_code", *MOVE, *QUATERNION, reach.alias("d_dist"))
    rows = stored(rows.withColumns({c: F.coalesce(F.floor(F.col(t) / F.col("d_dist")).cast("long"), F.lit(0)) for c, t in zip(_BOX, MOVE)}))
    joined = _strongest_near(rows, greedy_seeds(rows, rotation), rotation).withColumnsRenamed({"n_code": "seed", "n_cnt": "top"})
    side = F.when(V.dot(tuple(F.col(c) for c in QUATERNION), tuple(F.col("n_" + c) for c in QUATERNION)) < 0, -1.0).otherwise(1.0)
    sums = [F.avg(c).alias(c) for c in MOVE] + [F.avg(side * F.col(c)).alias(c) for c in QUATERNION]
    out = joined.groupBy(*PAIR, "seed", "top").agg(F.sum("cnt").alias("votes"), F.count("*").alias("n_poses"), *sums)
    w = Window.partitionBy(*PAIR).orderBy(F.col("votes").desc(), F.col("top").desc(), F.col("seed"))
    out = out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= keep)
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in QUATERNION), F.lit(0.0)))
    return out.select(*PAIR, "rank", "votes", "n_poses", *MOVE, *[(F.col(c) / size).alias(c) for c in QUATERNION])


def cluster_poses(clusters: DataFrame) -> DataFrame:
    """PAIR, score (a cluster's votes) and t11 ... t34 of clusters as greedy_clusters() gives them."""
    t = rigid.from_quaternion(tuple(F.col(c) for c in QUATERNION)), V.vec(*MOVE)
    return clusters.select(*PAIR, F.col("votes").cast("double").alias("score"), *[c.alias(n) for n, c in rigid.to_columns(t).items()])


def three_transforms(cells: DataFrame, scene: DataFrame, model: DataFrame) -> DataFrame:
    """cells (PAIR, s_r, m_r, turn) with the model's frame m_t11 ..., the scene's frame s_t11 ... (either puts its
    reference point at the origin and the normal on the x axis) and the turn about that axis, a_t11 ..."""
    df = _frame_stages(_frame_stages(with_points(cells, scene, model), "s_"), "m_")
    out = {}
    for p in ("m_", "s_"):
        r = tuple(F.col(f"{p}f{k}") for k in range(9))
        t = r, V.scale(rigid.turn(r, V.vec(*[p + a for a in POINT])), -1.0)
        out |= {p + n: c for n, c in rigid.to_columns(t).items()}
    out |= {"a_" + n: c for n, c in rigid.to_columns((rigid.rotx(F.col("turn")), V.literal(0.0, 0.0, 0.0))).items()}
    return df.select(*[F.col(x) for x in cells.columns], *[c.alias(n) for n, c in out.items()])


def compared(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """PAIR, trans_err, rot_err; both sides: PAIR, t11 ... t34. A truth without an estimate has nulls."""
    t = truth.select(*PAIR, *[F.col(c).alias("g_" + c) for c in rigid.NAMES])
    d, r = rigid.distance(rigid.from_columns(), rigid.from_columns("g_"))
    return t.join(estimates.select(*PAIR, *rigid.NAMES), PAIR, "left").select(*PAIR, d.alias("trans_err"), r.alias("rot_err"))


def validated(errors: DataFrame, diameters: DataFrame, trans: float = 0.1, degrees: float = 12.0) -> DataFrame:
    """errors with trans_match, rot_match, match: under trans times the model's diameter and under so many degrees."""
    rows = lookup(errors, diameters.select("model_id", "diam"), ["model_id"], "left")
    a, b = F.coalesce(F.col("trans_err") < trans * F.col("diam"), F.lit(False)), F.coalesce(F.col("rot_err") < math.radians(degrees), F.lit(False))
    return rows.select(*errors.columns, a.alias("trans_match"), b.alias("rot_match"), (a & b).alias("match"))


def proper(poses: DataFrame) -> DataFrame:
    """Poses whose rotation doesn't mirror."""
    return poses.filter(rigid.determinant(rigid.from_columns()[0]) > 0)


def at_ranks(found: DataFrame, ranks: tuple[int, ...] = (2, 6, 11, 51)) -> DataFrame:
    w = Window.partitionBy(*PAIR).orderBy(F.col("cnt").desc(), F.col("vote_code"))
    out = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= max(ranks))
    return out.filter(F.col("rank").isin(*ranks)).select(*PAIR, "rank", "cnt")
