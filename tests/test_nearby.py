"""Scores and greedy clusters of poses in blocks of cells, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import nearby, poses

ID = ["scene_id", "model_id", "vote_code"]


def made(spark, n: int = 400):
    """Poses about cell 0, a third of them copies of one place and turn, one that isn't a number."""
    g = np.random.default_rng(3)
    q = g.normal(size=(n, 4)) * 0.15 + [1, 0, 0, 0]
    q /= np.sqrt((q * q).sum(1))[:, None]
    t = g.uniform(-0.7, 0.7, (n, 3))
    q[::3], t[::3] = q[0], t[0]
    t[5] = np.nan
    rows = [(1, k % 2, k, int(g.integers(1, 9)), *map(float, q[k]), *map(float, t[k])) for k in range(n)]
    df = spark.createDataFrame(rows, ", ".join(["scene_id int, model_id int, vote_code long, cnt long", *[f"{c} double" for c in (*poses.QUATERNION, *poses.MOVE)]]))
    df = df.withColumns({"w_cnt": F.col("cnt").cast("double"), "d_dist": F.lit(0.2)})
    return poses.cells(df, F.col("d_dist")), rows


def test_scores_in_blocks(spark):
    df, rows = made(spark)
    plan = poses.neighbour_scores(df, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("MapInArrow", 1)[0]  # poses meet in the tasks, not as rows for each of 27 cells
    for most in (nearby.OWN, 7):
        got = {tuple(r[c] for c in ID): r["score"] for r in poses.neighbour_scores(df, None, most=most).select(*ID, "score").collect()}
        want = {}
        for a in rows:
            score = 1.0
            for b in rows:
                ca, cb = (np.floor(np.array(x[8:]) / 0.2) for x in (a, b))
                if a[1] == b[1] and np.abs(ca - cb).max() <= 1 and (ca != cb).any() and abs(8 * (1 - np.dot(a[4:8], b[4:8]))) < poses.ROTATION_STEP**2 and np.linalg.norm(np.subtract(a[8:], b[8:])) < 0.2:
                    score += b[3]
            want[a[:3]] = score
        assert got == want


def test_greedy_in_blocks(spark):
    df, rows = made(spark)
    got = {(r["model_id"], r["rank"]): (r["votes"], r["n_poses"]) for r in poses.greedy_clusters(df, rotation=0.21, keep=1000).collect()}
    for model in (0, 1):
        seeds = []
        for a in sorted((x for x in rows if x[1] == model), key=lambda x: (-x[3], x[2])):
            near = [s for s in seeds if np.linalg.norm(np.subtract(a[8:], s[0][8:])) < 0.2 and 2 * np.arccos(min(1.0, abs(np.dot(a[4:8], s[0][4:8])))) < 0.21]
            if near:
                near[0][1].append(a)
            else:
                seeds.append((a, [a]))
        want = sorted(((sum(x[3] for x in m), len(m)) for _, m in seeds), key=lambda x: -x[0])
        own = [got[model, k + 1] for k in range(len(want))]
        assert sum(k[0] == model for k in got) == len(want) and sorted(own) == sorted(want) and [x[0] for x in own] == [x[0] for x in want]
