"""Every query of the recognition operators against the same rows from another engine."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import features, rigid
from quillstone.operators import clouds, medians, pairs, poses, runs, voting
from quillstone.plans import catalogue, model_index, registration
from quillstone.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert ours
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(tuple(str(r[k]) for k in at) for r in found.fetchall())


def greedy(poses, reach, turn):
    """Clusters of (count, code, translation, quaternion): [(votes, members)], of most votes first."""
    clusters = []
    for pose in sorted(poses, key=lambda p: (-p[0], p[1])):
        for c in clusters:
            seed = c[0]
            angle = 2 * np.arccos(min(1.0, abs(float(np.dot(seed[3], pose[3])))))
            if np.linalg.norm(np.subtract(seed[2], pose[2])) < reach and angle < turn:
                c.append(pose)
                break
        else:
            clusters.append([pose])
    order = sorted(range(len(clusters)), key=lambda k: (-sum(p[0] for p in clusters[k]), k))
    return [(sum(p[0] for p in clusters[k]), clusters[k]) for k in order]


def test_greedy_clusters(spark, sf_dir):
    made = catalogue.apart_poses(spark, sf_dir).collect()
    want = greedy([(r["cnt"], r["vote_code"], [r[c] for c in poses.MOVE], [r[c] for c in poses.QUATERNION]) for r in made], made[0]["d_dist"], features.D_ANGLE)[:3]
    got = sorted(QUERIES["greedy_cluster"](spark, sf_dir).collect(), key=lambda r: r["rank"])
    assert [(r["votes"], r["n_poses"]) for r in got] == [(v, len(c)) for v, c in want]
    for r, (_, c) in zip(got, want):
        assert np.allclose([r[x] for x in poses.MOVE], np.mean([p[2] for p in c], axis=0), atol=1e-5)


def test_greedy_answers_of_many_models(spark, sf_dir):
    c = catalogue.cloud(spark, sf_dir)
    moved = clouds.transformed(c, rigid.literal(catalogue._T)).filter("cloud_id < 3")
    found = registration.register(moved, c.filter("cloud_id < 2"), registration.Options(greedy=True)).collect()
    assert len(found) == 6
    for r in found:
        if r["scene_id"] == r["model_id"]:  # the model itself, at the pose by which scenes are moved
            assert np.allclose([r[n] for n in rigid.NAMES], np.array(catalogue._T).ravel(), atol=0.25) and r["score"] > 100


def test_split_bins_give_the_same_candidates(spark, sf_dir, monkeypatch):
    want = sorted(catalogue.all_candidates(spark, sf_dir, True).collect())
    monkeypatch.setattr(voting, "SMALL_ROWS", 0)
    monkeypatch.setattr(voting._split, "__defaults__", (3,))
    assert sorted(catalogue.all_candidates(spark, sf_dir, True).collect()) == want


def test_cut_cells_give_the_same_scores(spark, sf_dir):
    """Few poses to a piece, and all poses in one cell."""
    made = catalogue.apart_poses(spark, sf_dir)
    for p in (made, made.withColumns({c: F.lit(0).cast("long") for c in poses.CELL})):
        key = lambda df: sorted((r["vote_code"], round(r["score"], 9), round(r["ax"], 9)) for r in df.collect())
        for own in (False, True):
            assert key(poses.neighbour_scores(p, None, own, most=3)) == key(poses.neighbour_scores(p, None, own))


def test_seeds_in_rounds(spark):
    """Chains of poses, each near the next: seeds depend on the order all along, and equal counts go by code."""
    r = np.random.default_rng(5)
    rows = []
    for pair in range(4):
        for k in range(60):
            q = r.normal(size=4) * [1, 0.04, 0.04, 0.04] + [3, 0, 0, 0]
            q /= np.linalg.norm(q)
            rows.append((pair % 2, pair // 2, int(r.integers(1, 5)), k, *(r.normal(size=3) * [6, 0.4, 0.4]).tolist(), *q.tolist(), 1.0 + pair % 2))
    df = spark.createDataFrame(rows, "scene_id int, model_id int, cnt long, vote_code long, " + ", ".join(f"{c} double" for c in (*poses.MOVE, *poses.QUATERNION, "d_dist")))
    got = poses.greedy_clusters(df, keep=100).collect()
    for s in (0, 1):
        for m in (0, 1):
            mine = [x for x in rows if x[:2] == (s, m)]
            want = greedy([(x[2], x[3], x[4:7], x[7:11]) for x in mine], mine[0][11], features.D_ANGLE)
            own = sorted((x for x in got if (x["scene_id"], x["model_id"]) == (s, m)), key=lambda x: x["rank"])
            assert [(x["votes"], x["n_poses"]) for x in own] == [(v, len(c)) for v, c in want] and len(want) > 5
            assert np.allclose([[x[c] for c in poses.MOVE] for x in own], [np.mean([p[2] for p in c], axis=0) for _, c in want])


def test_candidates_of_models_of_many_sizes(spark, sf_dir):
    """Models whose steps lie octaves apart, and alike: pairs meet by cells as they would model by model."""
    c = catalogue.cloud(spark, sf_dir).filter("cloud_id < 4")
    scale = F.element_at(F.array(*[F.lit(x) for x in (1.0, 1.07, 3.9, 40.0)]), F.col("cloud_id") + 1)
    models = c.withColumns({a: F.col(a) * scale for a in clouds.POINT})
    steps = registration.model_steps(models, 0.05)
    scene = catalogue.cloud(spark, sf_dir).filter("cloud_id > 3").withColumns({"x": F.col("x") * 5})
    names = ["scene_id", "model_id", "s_r", "m_r", "alpha"]
    found = registration.found_candidates(scene, models, steps)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    want = []
    for r in steps.collect():
        own = pairs.distance_bin(pairs.angle_bins(pairs.point_pair_features(scene)), r["d_dist"]).withColumnRenamed("cloud_id", "scene_id")
        want += voting.candidates(own, registration.binned_models(models.filter(F.col("cloud_id") == r["model_id"]), steps)).select(*names).collect()
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, want)) and len({r[1] for r in want}) > 2


def test_a_stored_index_is_probed_without_model_pairs(spark, sf_dir, tmp_path):
    c = catalogue.cloud(spark, sf_dir)
    models, scenes = c.filter("cloud_id < 3"), clouds.transformed(c, rigid.literal(catalogue._T)).filter("cloud_id < 2")
    index = model_index.build(models, str(tmp_path / "index"), buckets=5, most=4)
    assert index.heavy.count() > 0
    spark.sql(f"DROP TABLE {model_index._name(str(tmp_path / 'index'))}")  # as in another session; its files stay
    index = model_index.open_index(spark, str(tmp_path / "index"))
    found = model_index.probe(index, scenes, exact=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        plan = model_index.probe(index, scenes)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and len(re.findall(r"Exchange hashpartitioning.*ENSURE_REQUIREMENTS", plan)) == 1  # of scene pairs
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    names = ["scene_id", "model_id", "s_r", "s_i", "m_r", "m_i", "alpha"]
    want = registration.found_candidates(scenes, models, registration.model_steps(models, 0.05), exact=True)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    assert sorted(map(tuple, model_index.register(index, scenes).collect())) == sorted(map(tuple, registration.register(scenes, models).collect()))


def test_random_sample_is_the_least_numbers(spark, sf_dir):
    drawn = {(r["cloud_id"], r["pt_id"]) for r in QUERIES["random_downsample"](spark, sf_dir).collect()}
    c = catalogue.cloud(spark, sf_dir)
    rows = c.select("cloud_id", "pt_id", F.xxhash64(F.lit(7), *c.columns).alias("h")).collect()
    for k in {r["cloud_id"] for r in rows}:
        own = sorted((r["h"] % (1 << 64), r["pt_id"]) for r in rows if r["cloud_id"] == k)
        assert {p for _, p in own[: int(0.25 * len(own))]} == {p for i, p in drawn if i == k}


def test_medians(spark):
    """Values spread over all magnitudes, values that repeat, few and none."""
    r = np.random.default_rng(2)
    rows = [("a", float(x), float(y)) for x, y in zip(r.normal(size=501), r.integers(0, 3, 501))] + [("b", float(x), None) for x in 10.0 ** r.uniform(-300, 300, 200)] + [("c", 5.0, 1.0), ("d", None, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    for cuts, few in ((7, 10), (63, 1000)):
        got = {m["k"]: (m["median_x"], m["median_y"]) for m in medians.medians(df, ["x", "y"], ["k"], cuts, few).collect()}
        for k in "abcd":
            for n, c in enumerate(("x", "y")):
                own = [v[n + 1] for v in rows if v[0] == k and v[n + 1] is not None and v[n + 1] == v[n + 1]]
                assert got[k][n] == (pytest.approx(np.median(own), rel=1e-15) if own else None)
    one = medians.medians(df, ["x"]).first()
    assert one["median_x"] == pytest.approx(np.median([v[1] for v in rows if v[1] is not None]), rel=1e-15)
    assert medians.medians(df.limit(0), ["x"]).first()["median_x"] is None


def test_running_sums_of_a_frequent_value(spark):
    rows = [(1, k, k % 3) for k in range(500)] + [(k, 0, 1) for k in range(2, 50)]
    df = spark.createDataFrame(rows, "a long, b long, v long").repartition(5)
    got = [tuple(r) for r in runs.running_sums(df, ["a", "b"], {"s": F.col("v"), "n": F.lit(1)}).orderBy("a", "b").collect()]
    sums = np.cumsum([r[2] for r in rows]).tolist()
    assert got == [(*r, s, k + 1) for k, (r, s) in enumerate(zip(rows, sums))]
    before = [r["s"] for r in runs.running_sums(df, ["a", "b"], {"s": F.col("v")}, before=True).orderBy("a", "b").collect()]
    assert before == [0, *sums[:-1]]


def test_point_votes(spark, sf_dir):
    c = catalogue.cloud(spark, sf_dir)
    m, scene = c.filter("cloud_id = 0"), clouds.transformed(c.filter("cloud_id = 0"), rigid.literal(catalogue._T)).withColumn("cloud_id", F.lit(100))
    index, steps = registration.describe_model(m)
    assert index.count() > 0 and steps.count() == 1
    out = registration.vote_by_points(scene, m, steps)
    assert out.best.count() == out.accumulator.select("s_r").distinct().count() <= m.filter("pt_id % 5 = 0").count()
    top = out.top.first()["top"]
    assert top == out.accumulator.agg(F.max("cnt")).first()[0]
    for r in out.transforms.collect():  # inverse of the scene's frame, the turn, the model's frame
        t = {p: np.vstack([np.array([r[p + n] for n in rigid.NAMES]).reshape(3, 4), [0, 0, 0, 1]]) for p in ("m_", "s_", "a_")}
        assert r["m_r"] == r["s_r"] and np.allclose((np.linalg.inv(t["s_"]) @ t["a_"] @ t["m_"])[:3], catalogue._T, atol=1e-9)
