"""The queries of the recognition operators, each with the SQL of another engine for the same rows.

The tables have no point clouds: the view `cloud` (operators.clouds.from_embeddings) makes them of vectors.
Floating results are rounded to six decimals on both sides.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, hashing, rigid
from ..functions import vectors as V
from ..functions.text import model_name
from ..operators import blocks, clouds, evaluation, meshes, pairs, poses, synthesis, voting
from ..operators.joins import lookup
from ..operators.tables import kept, shared_folder, stored
from ..sources import ply, sink, texts
from . import files, model_index, registration

TAU, THRESHOLD = 0.05, 0.4
D = features.D_ANGLE
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def quick_r6(c: str) -> Column:
    """r6() of doubles. round() goes through decimals, at many times the cost: here only values near the middle of two steps do."""
    x = F.col(c)
    k = F.floor(x * 1e6 + 0.5)
    return F.when((F.abs(x) < 1e6) & (F.abs(x * 1e6 - k) < 0.499), k / 1e6).otherwise(F.round(x, 6)) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.from_embeddings(table(spark, sf_dir, "embeddings"))


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).filter("cloud_id = 0")


def scene_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).withColumn("cloud_id", F.lit(100))


def scene_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).filter("cloud_id <> 0").withColumn("cloud_id", F.lit(100))


# ---- pieces of the SQL side

CLOUD = "cloud AS (SELECT label AS cloud_id, vec_id AS pt_id, " + ", ".join(f"CAST(embedding[{k}] AS DOUBLE) AS {c}" for k, c in enumerate(clouds.FIELDS, 1)) + " FROM embeddings)"
MODEL = "model AS (SELECT * FROM cloud WHERE cloud_id = 0)"
MODELS = "model AS (SELECT * FROM cloud)"
ALL = "scene AS (SELECT * REPLACE (100 AS cloud_id) FROM cloud)"
APART = "scene AS (SELECT * REPLACE (100 AS cloud_id) FROM cloud WHERE cloud_id <> 0)"
EXTENT = "greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z))"


def s6(e: str) -> str:
    return f"(round({e}, 6) + 0.0)"


def clamp_sql(e: str) -> str:
    return f"CASE WHEN {e} > 1 THEN 1.0 WHEN {e} < -1 THEN -1.0 ELSE {e} END"


def ppf_sql(name: str, src: str, condition: str = "TRUE") -> str:
    return f"""{name}_1 AS (
  SELECT a.cloud_id, a.pt_id AS r, b.pt_id AS i, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz,
    a.nx, a.ny, a.nz, b.nx AS mx, b.ny AS my, b.nz AS mz
  FROM {src} a JOIN {src} b ON a.cloud_id = b.cloud_id AND a.pt_id <> b.pt_id WHERE {condition}
), {name}_2 AS (
  SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS f1, sqrt(nx * nx + ny * ny + nz * nz) AS nn, sqrt(mx * mx + my * my + mz * mz) AS mm, atan2(nz, nx) AS py FROM {name}_1
), {name}_3 AS (
  SELECT *, (nx * dx + ny * dy + nz * dz) / nullif(nn * f1, 0) AS c2, (mx * dx + my * dy + mz * dz) / nullif(mm * f1, 0) AS c3,
    (nx * mx + ny * my + nz * mz) / nullif(nn * mm, 0) AS c4, -atan2(ny, cos(py) * nx + sin(py) * nz) AS pz FROM {name}_2
), {name} AS (
  SELECT cloud_id, r, i, f1, acos({clamp_sql("c2")}) AS f2, acos({clamp_sql("c3")}) AS f3, acos({clamp_sql("c4")}) AS f4,
    atan2(-sin(py) * dx + cos(py) * dz, sin(pz) * (cos(py) * dx + sin(py) * dz) + cos(pz) * dy) AS a FROM {name}_3
)"""


def bin_sql(e: str, step: str) -> str:
    return f"CAST(round(({e} - {e} % {step}) / {step}) AS BIGINT)"


def bins_sql(name: str, src: str, d_dist: str = "d_dist") -> str:
    k = ", ".join(f"{bin_sql(f'f{n}', d_dist if n == 1 else repr(D))} AS k{n}" for n in range(1, 5))
    return f"{name} AS (SELECT * FROM (SELECT *, {k} FROM {src}) WHERE k1 IS NOT NULL AND k2 IS NOT NULL AND k3 IS NOT NULL AND k4 IS NOT NULL)"


STEP = f"step AS (SELECT cloud_id AS model_id, {TAU!r} * {EXTENT} AS d_dist, {EXTENT} AS diam FROM model GROUP BY cloud_id)"


def votes_sql(scene: str) -> str:
    """CTEs up to votes, for the views scene and model."""
    pi = "3.141592653589793"
    return ", ".join(
        [
            CLOUD, MODEL, scene, STEP, ppf_sql("mppf", "model"), ppf_sql("sppf", "scene"),
            "mjoin AS (SELECT p.*, s.d_dist, s.model_id FROM mppf p JOIN step s ON p.cloud_id = s.model_id)",
            bins_sql("mbin", "mjoin"),
            "sjoin AS (SELECT p.*, s.d_dist, s.model_id FROM sppf p CROSS JOIN step s)",
            bins_sql("sbin", "sjoin"),
            "cand_1 AS (SELECT s.cloud_id AS scene_id, m.model_id, s.r AS s_r, m.r AS m_r, s.a - m.a AS d FROM sbin s JOIN mbin m ON s.model_id = m.model_id AND s.k1 = m.k1 AND s.k2 = m.k2 AND s.k3 = m.k3 AND s.k4 = m.k4)",
            f"cand_2 AS (SELECT scene_id, model_id, s_r, m_r, CASE WHEN d > {pi} THEN d - 2 * {pi} WHEN d <= -{pi} THEN d + 2 * {pi} ELSE d END + {pi} AS u FROM cand_1)",
            f"cand AS (SELECT scene_id, model_id, s_r, m_r, least({bin_sql('u', repr(D))}, 29) AS alpha FROM cand_2)",
            "votes AS (SELECT *, (s_r << 32) | (m_r << 6) | alpha AS vote_code FROM (SELECT scene_id, model_id, s_r, m_r, alpha, count(*) AS cnt FROM cand GROUP BY ALL))",
            f"pruned AS (SELECT * FROM votes QUALIFY cnt > {THRESHOLD} * max(cnt) OVER (PARTITION BY scene_id, model_id))",
        ]
    )


def _mul(a: list[str], b: list[str]) -> list[str]:
    return ["(" + " + ".join(f"{a[3 * r + k]} * {b[3 * k + c]}" for k in range(3)) + ")" for r in range(3) for c in range(3)]


def _frame_sql(p: str) -> list[str]:
    """Rz(z) Ry(y) of columns {p}y, {p}z."""
    cy, sy, cz, sz = f"cos({p}y)", f"sin({p}y)", f"cos({p}z)", f"sin({p}z)"
    return [f"{cz} * {cy}", f"-{sz}", f"{cz} * {sy}", f"{sz} * {cy}", cz, f"{sz} * {sy}", f"-{sy}", "0.0", cy]


def poses_sql() -> str:
    names = [f"{p}{k}" for p in ("u", "v") for k in range(9)]
    columns = ", ".join(f"{e} AS {n}" for e, n in zip(_frame_sql("fs") + _frame_sql("fm"), names))
    rx = ["1.0", "0.0", "0.0", "0.0", "cos(g)", "-sin(g)", "0.0", "sin(g)", "cos(g)"]
    mid = ", ".join(f"{e} AS w{k}" for k, e in enumerate(_mul(rx, [f"v{k}" for k in range(9)])))
    rot = ", ".join(f"{e} AS q{k}" for k, e in enumerate(_mul([f"u{3 * c + r}" for r in range(3) for c in range(3)], [f"w{k}" for k in range(9)])))
    t = ", ".join(f"q{3 * r} AS t{r + 1}1, q{3 * r + 1} AS t{r + 1}2, q{3 * r + 2} AS t{r + 1}3, s{c} - (q{3 * r} * mx + q{3 * r + 1} * my + q{3 * r + 2} * mz) AS t{r + 1}4" for r, c in enumerate("xyz"))
    return ", ".join(
        [
            f"pose_1 AS (SELECT p.*, p.alpha * {D!r} - 3.141592653589793 AS g, s.x AS sx, s.y AS sy, s.z AS sz, m.x AS mx, m.y AS my, m.z AS mz, atan2(s.nz, s.nx) AS fsy, s.nx AS snx, s.ny AS sny, s.nz AS snz, atan2(m.nz, m.nx) AS fmy, m.nx AS mnx, m.ny AS mny, m.nz AS mnz, t.d_dist FROM pruned p JOIN scene s ON p.scene_id = s.cloud_id AND p.s_r = s.pt_id JOIN model m ON p.model_id = m.cloud_id AND p.m_r = m.pt_id JOIN step t ON p.model_id = t.model_id)",
            "pose_2 AS (SELECT *, -atan2(sny, cos(fsy) * snx + sin(fsy) * snz) AS fsz, -atan2(mny, cos(fmy) * mnx + sin(fmy) * mnz) AS fmz FROM pose_1)",
            f"pose_3 AS (SELECT *, {columns} FROM pose_2)", f"pose_4 AS (SELECT *, {mid} FROM pose_3)", f"pose_5 AS (SELECT *, {rot} FROM pose_4)",
            f"pose AS (SELECT scene_id, model_id, s_r, m_r, alpha, cnt, vote_code, d_dist, {t} FROM pose_5)",
        ]
    )


def quaternion_sql(src: str = "pose", name: str = "quat") -> str:
    root = lambda e: f"0.5 * sqrt(greatest({e}, 0.0))"
    sign = lambda e, s: f"CASE WHEN {s} < 0 THEN -({e}) ELSE {e} END"
    q = [root("1 + t11 + t22 + t33"), sign(root("1 + t11 - t22 - t33"), "t32 - t23"), sign(root("1 - t11 + t22 - t33"), "t13 - t31"), sign(root("1 - t11 - t22 + t33"), "t21 - t12")]
    raw = ", ".join(f"{e} AS h{c}" for e, c in zip(q, "wxyz"))
    n = "sqrt(hw * hw + hx * hx + hy * hy + hz * hz)"
    return f"{name}_1 AS (SELECT *, {raw} FROM {src}), {name} AS (SELECT * EXCLUDE (hw, hx, hy, hz), " + ", ".join(f"h{c} / {n} AS q{c}" for c in "wxyz") + f", t14 AS tx, t24 AS ty, t34 AS tz FROM {name}_1)"


CELLS = "celled AS (SELECT *, CAST(floor(tx / d_dist) AS BIGINT) AS cx, CAST(floor(ty / d_dist) AS BIGINT) AS cy, CAST(floor(tz / d_dist) AS BIGINT) AS cz, CAST(cnt AS DOUBLE) AS w_cnt FROM quat)"


def scores_sql(any_distance: bool = False) -> str:
    gap = "abs(8 * (1 - (a.qw * b.qw + a.qx * b.qx + a.qy * b.qy + a.qz * b.qz))) < " + repr(poses.ROTATION_STEP**2)
    near = "" if any_distance else " AND sqrt((a.tx - b.tx) * (a.tx - b.tx) + (a.ty - b.ty) * (a.ty - b.ty) + (a.tz - b.tz) * (a.tz - b.tz)) < a.d_dist"
    cell = " AND ".join(f"abs(a.c{c} - b.c{c}) <= 1" for c in "xyz")
    return f"""sums AS (
  SELECT a.scene_id, a.model_id, a.vote_code, sum(b.w_cnt) AS w, sum(b.w_cnt * b.tx) AS sx, sum(b.w_cnt * b.ty) AS sy, sum(b.w_cnt * b.tz) AS sz
  FROM celled a JOIN celled b ON a.scene_id = b.scene_id AND a.model_id = b.model_id AND {cell} AND NOT (a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz) AND {gap}{near}
  GROUP BY ALL
), scored AS (
  SELECT c.*, 1.0 + coalesce(w, 0.0) AS score, (c.tx + coalesce(sx, 0.0)) / (1.0 + coalesce(w, 0.0)) AS ax, (c.ty + coalesce(sy, 0.0)) / (1.0 + coalesce(w, 0.0)) AS ay, (c.tz + coalesce(sz, 0.0)) / (1.0 + coalesce(w, 0.0)) AS az
  FROM celled c LEFT JOIN sums USING (scene_id, model_id, vote_code)
)"""


VOTES = f"WITH {votes_sql(ALL)} "
POSES = f"WITH {votes_sql(APART)}, {poses_sql()} "
QUATS = POSES + ", " + quaternion_sql() + " "
SCORES = QUATS + f", {CELLS}, {scores_sql()} "
MATRIX6 = ", ".join(f"{s6(n)} AS {n}" for n in rigid.NAMES)


def all_votes(spark, sf_dir, exact: bool = False, threshold: float = 0.0, give: tuple | None = None) -> DataFrame:
    m = model(spark, sf_dir)
    return registration.found_votes(scene_all(spark, sf_dir), m, registration.model_steps(m, TAU), exact=exact, threshold=threshold, give=give)


def given_votes(spark, sf_dir, name: str) -> DataFrame:
    return all_votes(spark, sf_dir, give=blocks.VOTES_GIVEN[name])


def pruned_apart(spark, sf_dir) -> DataFrame:
    m = model(spark, sf_dir)
    return voting.pruned(stored(registration.found_votes(scene_apart(spark, sf_dir), m, registration.model_steps(m, TAU), threshold=THRESHOLD)), THRESHOLD)


def apart_poses(spark, sf_dir) -> DataFrame:
    m = model(spark, sf_dir)
    return registration.vote_poses(pruned_apart(spark, sf_dir), scene_apart(spark, sf_dir), m, registration.model_steps(m, TAU))


# ---- sampling and extents

@query(f"WITH {CLOUD} SELECT cloud_id, CAST(floor(x / 0.1) AS BIGINT) AS c0, CAST(floor(y / 0.1) AS BIGINT) AS c1, CAST(floor(z / 0.1) AS BIGINT) AS c2, " + ", ".join(f"{s6(f'avg({c})')} AS {c}" for c in clouds.FIELDS) + ", count(*) AS n FROM cloud GROUP BY ALL")
def voxel_downsample(spark, sf_dir):
    return rounded(clouds.voxel_downsample(cloud(spark, sf_dir), 0.1), *clouds.FIELDS)


@query("SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS c0, CAST(floor(l_extendedprice / 5000.0) AS BIGINT) AS c1, CAST(floor(l_discount / 0.025) AS BIGINT) AS c2, round(avg(l_quantity), 9) AS l_quantity, round(avg(l_extendedprice), 7) AS l_extendedprice, round(avg(l_discount), 9) AS l_discount, count(*) AS n FROM lineitem GROUP BY ALL")
def voxel_downsample_lineitem(spark, sf_dir):
    fields = ("l_quantity", "l_extendedprice", "l_discount")
    out = clouds.voxel_downsample(table(spark, sf_dir, "lineitem"), (5.0, 5000.0, 0.025), (), fields, fields)
    return out.withColumns({c: F.round(c, k) for c, k in zip(fields, (9, 7, 9))})


@query(f"WITH {CLOUD} SELECT cloud_id, pt_id FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY pt_id) - 1 AS p FROM cloud) WHERE p % 5 = 0")
def seq_downsample(spark, sf_dir):
    return clouds.every_nth(cloud(spark, sf_dir), 5).select("cloud_id", "pt_id")


@query(f"WITH {CLOUD}, n AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY pt_id) - 1 AS p, count(*) OVER (PARTITION BY cloud_id) AS size FROM cloud), k AS (SELECT unnest(range(0, 7)) AS k) SELECT DISTINCT cloud_id, pt_id FROM n, k WHERE p = CAST(floor(1 + k * (size - 1) / 6.0) AS BIGINT) - 1")
def linspace_sample(spark, sf_dir):
    return clouds.evenly_spaced(cloud(spark, sf_dir), 7).select("cloud_id", "pt_id")


@query(f"WITH {CLOUD} SELECT cloud_id, pt_id FROM cloud WHERE pt_id % 5 = 0")
def ref_point_sample(spark, sf_dir):
    return clouds.reference_points(cloud(spark, sf_dir), 5).select("cloud_id", "pt_id")


@query()
def random_downsample(spark, sf_dir):
    return clouds.random_sample(cloud(spark, sf_dir), 0.25, 7).select("cloud_id", "pt_id")


@query(f"WITH {CLOUD} SELECT cloud_id, count(*) AS n FROM cloud GROUP BY ALL")
def cloud_sizes(spark, sf_dir):
    return clouds.sizes(cloud(spark, sf_dir))


@query(f"WITH {CLOUD} SELECT cloud_id, " + ", ".join(f"{f}({a}) AS {f}_{a}" for a in "xyz" for f in ("min", "max")) + f", count(*) AS n, {EXTENT} AS extent FROM cloud GROUP BY ALL")
def bbox_extent(spark, sf_dir):
    return clouds.extents(cloud(spark, sf_dir))


@query(f"WITH {CLOUD}, box AS (SELECT cloud_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM cloud GROUP BY ALL), r AS (SELECT cloud_id, max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) AS radius FROM cloud JOIN box USING (cloud_id) GROUP BY ALL) SELECT cloud_id, {s6('radius')} AS radius, {s6('0.1 * radius')} AS d_dist FROM r")
def model_radius(spark, sf_dir):
    return rounded(clouds.radii(cloud(spark, sf_dir)), "radius", "d_dist")


@query(f"WITH {CLOUD}, low AS (SELECT cloud_id, min(x) AS x, min(y) AS y, min(z) AS z FROM cloud GROUP BY ALL) SELECT " + ", ".join(f"{s6(f'greatest(0.0, max(abs({a}) + 1))')} AS t{a}" for a in "xyz") + " FROM low")
def trans_adj(spark, sf_dir):
    return rounded(clouds.shift_to_positive(cloud(spark, sf_dir)), "tx", "ty", "tz")


@query(f"WITH {CLOUD}, m AS (SELECT cloud_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM cloud GROUP BY ALL) SELECT cloud_id, pt_id, {s6('x - mx + 1')} AS x, {s6('y - my + 1')} AS y, {s6('z - mz + 1')} AS z FROM cloud JOIN m USING (cloud_id)")
def centroid_center(spark, sf_dir):
    return rounded(clouds.centered(cloud(spark, sf_dir), 1.0), "x", "y", "z").select("cloud_id", "pt_id", "x", "y", "z")


# ---- features

@query(f"WITH {CLOUD}, {ppf_sql('p', 'cloud')} SELECT cloud_id, r, i, " + ", ".join(f"{s6(c)} AS {c}" for c in ("f1", "f2", "f3", "f4", "a")) + " FROM p")
def ppf(spark, sf_dir):
    return blocks.features_of(cloud(spark, sf_dir)).withColumns({c: quick_r6(c) for c in blocks.FEATURES})


def _bins(spark, sf_dir) -> DataFrame:
    """Of all clouds, each with its own step."""
    return blocks.binned(_stepped(spark, sf_dir), angle=False)


def _stepped(spark, sf_dir) -> DataFrame:
    """All clouds' points with the step of their own."""
    c = cloud(spark, sf_dir)
    return lookup(c, registration.model_steps(c, TAU).select(F.col("model_id").alias("cloud_id"), "d_dist"), ["cloud_id"])


MBINS = f"WITH {CLOUD}, {MODELS}, {STEP}, {ppf_sql('p', 'model')}, j AS (SELECT p.*, d_dist FROM p JOIN step ON p.cloud_id = step.model_id), {bins_sql('b', 'j')} "
CKEYS = ["cloud_id", *pairs.KEYS]


@query(MBINS + "SELECT cloud_id, r, i, k1, k2, k3, k4 FROM b")
def ppf_discretize(spark, sf_dir):
    return _bins(spark, sf_dir).select("cloud_id", "r", "i", *pairs.KEYS)


@query(f"WITH {CLOUD}, {ppf_sql('p', 'cloud', 'a.pt_id % 5 = 0')} SELECT cloud_id, r, count(*) AS n, {s6('sum(f1)')} AS total FROM p GROUP BY ALL")
def ppf_reference_factor(spark, sf_dir):
    return pairs.point_pair_features(cloud(spark, sf_dir), 5).groupBy("cloud_id", "r").agg(F.count("*").alias("n"), r6(F.sum("f1")).alias("total"))


@query(MBINS + "SELECT r, i, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, 16), lambda n: ((CASE n // 4 WHEN 0 THEN k1 WHEN 1 THEN k2 WHEN 2 THEN k3 ELSE k4 END) >> (8 * (n % 4))) & 255)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS key FROM b")
def fnv_hash(spark, sf_dir):
    return _bins(spark, sf_dir).select("r", "i", hashing.fnv32([F.col(k) for k in pairs.KEYS]).alias("key"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, upper(sha1(text)) AS sha1_upper, rtrim(to_base64(unhex(md5(text))), '=') AS md5_base64, substr(sha1(text), 1, 16) AS key FROM documents")
def content_hash(spark, sf_dir):
    t = F.col("text")
    d = hashing.digest
    return table(spark, sf_dir, "documents").select("doc_id", d(t).alias("md5"), d(t, "SHA-1").alias("sha1"), d(t, "SHA-256").alias("sha256"), d(t, "SHA-1", "HEX").alias("sha1_upper"), d(t, "MD5", "base64").alias("md5_base64"), hashing.key_of(t).alias("key"))


def _ends(*values: int) -> str:
    """Two numbers as little-endian doubles, in hexadecimal."""
    return struct.pack("<2d", *values).hex()


def _le(e: str, size: int) -> str:
    """A whole number as little-endian bytes, in hexadecimal."""
    h = f"lpad(to_hex({e}::{'BIGINT' if size == 8 else 'INTEGER'}), {2 * size}, '0')"
    return " || ".join(f"substr({h}, {2 * k - 1}, 2)" for k in range(size, 0, -1))


_hex = lambda s: s.encode().hex()
_char = lambda s: _hex("char") + _ends(1, len(s)) + s.encode("utf-16-le").hex()
_NESTED = " || ".join([
    f"'{_hex('struct') + _ends(1, 1) + _hex('cell') + _ends(3, 1) + _char('i') + _char('k') + _char('l')}'",
    f"'{_hex('int64') + _ends(1, 1)}'", _le("vec_id", 8),
    f"'{_hex('int64') + _ends(1, 3)}'", *[_le(f"vec_id * {k} + {k}", 8) for k in (1, 2, 3)],
    f"'{_hex('int32') + _ends(1, 1)}'", _le("label", 4),
])


@query(f"SELECT vec_id, md5(unhex({_NESTED})) AS digest FROM embeddings")
def typed_content(spark, sf_dir):
    """A digest by type and size of a nested column: a struct of a long, an array of longs and an integer."""
    k = F.array(*[F.col("vec_id") * k + k for k in (1, 2, 3)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.col("label").cast("int").alias("l"), F.col("vec_id").cast("long").alias("i"), k.alias("k")).alias("value"))
    return hashing.typed_digest(rows, "value").select("vec_id", "digest")


@query()
def md2_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.digest(F.col("text"), "MD2").alias("md2"))


@query(MBINS + "SELECT cloud_id, k1, k2, k3, k4, count(*) AS cnt FROM b GROUP BY ALL")
def ppf_index_histogram(spark, sf_dir):
    return blocks.bin_counts(_stepped(spark, sf_dir))


@query(MBINS + ", c AS (SELECT cloud_id, k1, k2, k3, k4, count(*) AS cnt FROM b GROUP BY ALL) SELECT *, CAST(coalesce(sum(cnt) OVER (ORDER BY cloud_id, k1, k2, k3, k4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM c")
def ppf_exclusive_scan(spark, sf_dir):
    return pairs.bin_offsets(blocks.bin_counts(_stepped(spark, sf_dir)), CKEYS)


#: Pairs of a bin in one row of the index: few, so that bins of these tables have several rows.
_POSTINGS = 16


@query(MBINS + f"SELECT cloud_id, k1, k2, k3, k4, (place - 1) // {_POSTINGS} AS block, list_aggregate(list_sort(list(r * 100000 + i)), 'string_agg', ',') AS pairs FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, k1, k2, k3, k4 ORDER BY r, i) AS place FROM b) GROUP BY ALL")
def inverted_index(spark, sf_dir):
    out = pairs.inverted_index(_bins(spark, sf_dir), CKEYS, _POSTINGS)
    return out.withColumn("pairs", F.array_join(F.transform("pairs", lambda p: (p["r"] * 100000 + p["i"]).cast("string")), ","))


@query(MBINS + "SELECT DISTINCT cloud_id, k1, k2, k3, k4 FROM b")
def distinct_keys(spark, sf_dir):
    return blocks.bin_counts(_stepped(spark, sf_dir)).drop("cnt")


@query("WITH v AS (SELECT event_id, value - 50 AS v FROM events) SELECT event_id, round(v - v % 0.4, 6) + 0.0 AS down, round(v - ((v % 0.4) + 0.4) % 0.4, 6) + 0.0 AS floored, CAST(round((v - v % 0.4) / 0.4) AS BIGINT) AS bin FROM v")
def quantize_variants(spark, sf_dir):
    v = F.col("v")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 50).alias("v"))
    return rows.select("event_id", r6(features.quantize_down(v, 0.4)).alias("down"), r6(v - ((v % 0.4) + 0.4) % 0.4).alias("floored"), features.bin_of(v, 0.4).alias("bin"))


@query(f"WITH {CLOUD} SELECT cloud_id, pt_id, {s6('x * nx + y * ny + z * nz')} AS dot, {s6('sqrt(x * x + y * y + z * z)')} AS norm, greatest(x, y, z) AS largest, least(x, y, z) AS smallest, {s6('y * nz - z * ny')} AS cx, {s6('z * nx - x * nz')} AS cy, {s6('x * ny - y * nx')} AS cz, {s6('sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny) + (z - nz) * (z - nz))')} AS distance, (x < nx OR (x = nx AND y < ny) OR (x = nx AND y = ny AND z < nz)) AS before, (x <> 0 OR y <> 0 OR z <> 0) AS set FROM cloud")
def vector_functions(spark, sf_dir):
    p, n = V.vec(*clouds.POINT), V.vec(*clouds.NORMAL)
    c = V.cross(p, n)
    return cloud(spark, sf_dir).select("cloud_id", "pt_id", r6(V.dot(p, n)).alias("dot"), r6(V.norm(p)).alias("norm"), V.largest(p).alias("largest"), V.smallest(p).alias("smallest"), *[r6(x).alias(a) for x, a in zip(c, ("cx", "cy", "cz"))], r6(V.distance(p, n)).alias("distance"), V.before(p, n).alias("before"), V.any_set(p).alias("set"))


# ---- votes

@query(VOTES + "SELECT scene_id, model_id, s_r, m_r, alpha, count(*) AS n FROM cand GROUP BY ALL")
def candidate_join(spark, sf_dir):
    return all_votes(spark, sf_dir).select(*voting.PAIR, "s_r", "m_r", "alpha", F.col("cnt").alias("n"))


@query(f"WITH {CLOUD}, {MODELS}, {STEP}, {ppf_sql('mppf', 'model')}, j AS (SELECT p.*, s.d_dist, s.model_id FROM mppf p JOIN step s ON p.cloud_id = s.model_id), {bins_sql('b', 'j')} SELECT model_id, {s6('any_value(s.d_dist)')} AS d_dist, count(*) AS pairs, count(DISTINCT (k1, k2, k3, k4)) AS bins, any_value(p.n) AS points FROM b JOIN step s USING (model_id) JOIN (SELECT cloud_id AS model_id, count(*) AS n FROM cloud GROUP BY ALL) p USING (model_id) GROUP BY model_id")
def build_index(spark, sf_dir):
    """All clouds' pairs, stored by bin; what the header says of each."""
    index = model_index.build(cloud(spark, sf_dir), _place(spark, "index"), TAU)
    return rounded(index.header.select("model_id", "d_dist", "pairs", "bins", "points"), "d_dist")


@query(VOTES + "SELECT scene_id, model_id, s_r, m_r, alpha, count(*) AS n FROM cand GROUP BY ALL")
def probe_index(spark, sf_dir):
    """The rows of candidate_join, by a stored index."""
    index = model_index.build(model(spark, sf_dir), _place(spark, "index"), TAU)
    return model_index.votes(index, scene_all(spark, sf_dir)).select(*voting.PAIR, "s_r", "m_r", "alpha", F.col("cnt").alias("n"))


@query(VOTES + "SELECT alpha, count(*) AS n FROM cand GROUP BY ALL")
def alpha_bin(spark, sf_dir):
    return given_votes(spark, sf_dir, "alphas").groupBy("alpha").agg(F.sum("cnt").alias("n")).filter("n > 0")


@query(VOTES + "SELECT vote_code, cnt FROM votes")
def vote_pack(spark, sf_dir):
    return all_votes(spark, sf_dir).select("vote_code", "cnt")


@query(VOTES + "SELECT vote_code, s_r, m_r, alpha, vote_code >> 32 AS high, vote_code & 4294967295 AS low FROM votes")
def vote_unpack(spark, sf_dir):
    codes = all_votes(spark, sf_dir).select("vote_code")
    return voting.unpacked(codes).withColumns({"high": V.high_32(F.col("vote_code")), "low": V.low_32(F.col("vote_code"))})


@query(VOTES + "SELECT scene_id, model_id, s_r, m_r, alpha, cnt FROM votes")
def vote_histogram(spark, sf_dir):
    return all_votes(spark, sf_dir).drop("vote_code")


@query(VOTES + "SELECT scene_id, model_id, s_r, m_r, alpha, cnt FROM pruned")
def vote_prune(spark, sf_dir):
    return voting.pruned(stored(all_votes(spark, sf_dir, threshold=THRESHOLD)), THRESHOLD).drop("vote_code")


@query(VOTES + "SELECT scene_id, model_id, count(*) AS n_votes, count(*) FILTER (WHERE cnt > 0.4 * top) AS n_kept FROM (SELECT *, max(cnt) OVER (PARTITION BY scene_id, model_id) AS top FROM votes) GROUP BY ALL")
def vote_kept_counts(spark, sf_dir):
    sizes = given_votes(spark, sf_dir, "sizes").groupBy(*voting.PAIR, "cnt").agg(F.sum("n").alias("n"))
    return voting.kept_counts(stored(sizes), THRESHOLD, "n")


@query(VOTES + "SELECT scene_id, model_id, vote_code, cnt, rank FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, model_id ORDER BY cnt DESC, vote_code) AS rank FROM votes) WHERE rank <= 100")
def vote_rank(spark, sf_dir):
    return voting.ranked(all_votes(spark, sf_dir, give=blocks.strongest(100)), 100).select(*voting.PAIR, "vote_code", "cnt", "rank")


@query(VOTES + "SELECT scene_id, model_id, rank, cnt FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, model_id ORDER BY cnt DESC, vote_code) AS rank FROM votes) WHERE rank IN (2, 6, 11, 51)")
def vote_rank_points(spark, sf_dir):
    return poses.at_ranks(all_votes(spark, sf_dir, give=blocks.strongest(51)))


@query(VOTES + "SELECT vote_code, weight, round(weight * cnt, 6) + 0.0 AS w_cnt FROM (SELECT *, CASE WHEN m_r % 3 = 0 THEN 0.5 + (m_r % 7) / 10.0 ELSE 1.0 END AS weight FROM votes)")
def weighted_votes(spark, sf_dir):
    weights = model(spark, sf_dir).filter("pt_id % 3 = 0").select(F.col("cloud_id").alias("model_id"), F.col("pt_id").alias("m_r"), (0.5 + (F.col("pt_id") % 7) / 10.0).alias("weight"))
    return rounded(voting.weighted(all_votes(spark, sf_dir), weights).select("vote_code", "weight", "w_cnt"), "w_cnt")


@query(VOTES + "SELECT scene_id, model_id, alpha, CAST(sum(cnt) AS BIGINT) AS n FROM votes GROUP BY ALL")
def alpha_histogram(spark, sf_dir):
    return voting.alpha_histogram(given_votes(spark, sf_dir, "alphas")).filter("n > 0")


BEST_POINT = ", best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY scene_id, model_id, s_r ORDER BY cnt DESC, alpha, m_r) = 1) "


@query(VOTES + BEST_POINT + "SELECT scene_id, model_id, s_r, m_r, alpha, cnt FROM best")
def matlab_accumulator_max(spark, sf_dir):
    return voting.best_by_scene_point(given_votes(spark, sf_dir, "best"))


@query(VOTES + BEST_POINT + "SELECT scene_id, model_id, s_r, m_r, alpha, cnt, round(share, 6) + 0.0 AS share FROM (SELECT *, cnt / max(cnt) OVER (PARTITION BY scene_id, model_id) AS share FROM best) WHERE share > 0.9")
def matlab_vote_threshold(spark, sf_dir):
    return rounded(voting.strong_scene_points(stored(voting.best_by_scene_point(given_votes(spark, sf_dir, "best")))), "share")


TURNS = VOTES.replace("cand_1 AS (SELECT s.cloud_id AS scene_id,", "cand_1 AS (SELECT s.i AS s_i, m.i AS m_i, s.cloud_id AS scene_id,").replace("cand_2 AS (SELECT scene_id,", "cand_2 AS (SELECT s_i, m_i, scene_id,").replace("cand AS (SELECT scene_id,", "cand AS (SELECT s_i, m_i, u, scene_id,")


@query(TURNS + "SELECT s_r, m_r, alpha, round(arg_max(u - 3.141592653589793, s_i * 100000000 + m_i), 6) + 0.0 AS turn FROM cand GROUP BY ALL")
def last_turns(spark, sf_dir):
    return rounded(all_votes(spark, sf_dir, True).select("s_r", "m_r", "alpha", "turn"), "turn")


@query(TURNS + "SELECT scene_id, model_id, least(CAST(floor(u / (2 * 3.141592653589793 / 99)) AS BIGINT) + 1, 100) AS edge, count(*) AS n FROM cand GROUP BY ALL")
def turn_histogram(spark, sf_dir):
    m = model(spark, sf_dir)
    return blocks.turn_histogram(scene_all(spark, sf_dir), m, registration.model_steps(m, TAU))


_RADIUS_STEP = "box AS (SELECT cloud_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM model GROUP BY ALL), step AS (SELECT cloud_id AS model_id, 0.1 * max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) AS d_dist FROM model JOIN box USING (cloud_id) GROUP BY ALL)"


def point_votes_sql() -> str:
    """Votes of every fifth scene point by steps of a tenth of the radius; of each point's strongest cell, if it has over 0.9 of
    the largest count, the transform by the exact angle of the cell's last candidate."""
    out = votes_sql(APART).replace(STEP, _RADIUS_STEP).replace(ppf_sql("sppf", "scene"), ppf_sql("sppf", "scene", "a.pt_id % 5 = 0"))
    out = out.replace("cand_1 AS (SELECT s.cloud_id AS scene_id,", "cand_1 AS (SELECT s.i AS s_i, m.i AS m_i, s.cloud_id AS scene_id,").replace("cand_2 AS (SELECT scene_id,", "cand_2 AS (SELECT s_i, m_i, scene_id,").replace("cand AS (SELECT scene_id,", "cand AS (SELECT s_i, m_i, u, scene_id,")
    out = out[: out.index("pruned AS")]
    best = "turns AS (SELECT scene_id, model_id, s_r, m_r, alpha, arg_max(u - 3.141592653589793, s_i * 100000000 + m_i) AS turn FROM cand GROUP BY ALL)" + BEST_POINT
    strong = ", pruned AS (SELECT * EXCLUDE (share) FROM (SELECT *, cnt / max(cnt) OVER (PARTITION BY scene_id, model_id) AS share FROM best) JOIN turns USING (scene_id, model_id, s_r, m_r, alpha) WHERE share > 0.9)"
    return f"WITH {out}{best}{strong}, " + poses_sql().replace(f"p.alpha * {D!r} - 3.141592653589793 AS g", "p.turn AS g")


@query(point_votes_sql() + f" SELECT s_r, m_r, alpha, cnt, {MATRIX6} FROM pose")
def point_votes(spark, sf_dir):
    """Voting by scene points as one call, and the model's transforms that its strong cells give."""
    m = model(spark, sf_dir)
    _, steps = registration.describe_model(m)
    out = registration.vote_by_points(scene_apart(spark, sf_dir), m, steps)
    t = rigid.compose(rigid.invert(rigid.from_columns("s_")), rigid.compose(rigid.from_columns("a_"), rigid.from_columns("m_")))
    cells = lookup(out.transforms, out.best.select("s_r", "m_r", "alpha", "cnt"), ["s_r", "m_r", "alpha"])
    return rounded(cells.select("s_r", "m_r", "alpha", "cnt", *[c.alias(n) for n, c in rigid.to_columns(t).items()]), *rigid.NAMES)


# ---- poses

@query(POSES + f"SELECT vote_code, cnt, {MATRIX6} FROM pose")
def pose_matrix(spark, sf_dir):
    return rounded(apart_poses(spark, sf_dir).select("vote_code", "cnt", *rigid.NAMES), *rigid.NAMES)


@query(POSES + "SELECT vote_code, " + ", ".join(f"{s6(f't{c}{r}')} AS t{r}{c}" for r in (1, 2, 3) for c in (1, 2, 3)) + ", " + ", ".join(f"{s6(f'-(t1{r} * t14 + t2{r} * t24 + t3{r} * t34)')} AS t{r}4" for r in (1, 2, 3)) + " FROM pose")
def rigid_inverse(spark, sf_dir):
    inverse = rigid.to_columns(rigid.invert(rigid.from_columns()))
    return apart_poses(spark, sf_dir).select("vote_code", *[r6(c).alias(n) for n, c in inverse.items()])


@query(QUATS + "SELECT vote_code, " + ", ".join(f"{s6(c)} AS {c}" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")) + " FROM quat")
def pose_quaternion(spark, sf_dir):
    return rounded(apart_poses(spark, sf_dir).select("vote_code", *poses.QUATERNION, *poses.MOVE), *poses.QUATERNION, *poses.MOVE)


_Q = ["1 - 2 * (qy * qy + qz * qz)", "2 * (qx * qy - qw * qz)", "2 * (qx * qz + qw * qy)", "2 * (qx * qy + qw * qz)", "1 - 2 * (qx * qx + qz * qz)", "2 * (qy * qz - qw * qx)", "2 * (qx * qz - qw * qy)", "2 * (qy * qz + qw * qx)", "1 - 2 * (qx * qx + qy * qy)"]


@query(QUATS + "SELECT vote_code, " + ", ".join(f"round({e}, 5) + 0.0 AS m{k}" for k, e in enumerate(_Q)) + " FROM quat")
def quat_to_matrix(spark, sf_dir):
    m = rigid.from_quaternion(tuple(F.col(c) for c in poses.QUATERNION))
    return apart_poses(spark, sf_dir).select("vote_code", *[(F.round(c, 5) + F.lit(0.0)).alias(f"m{k}") for k, c in enumerate(m)])


@query(QUATS + f", {CELLS} SELECT vote_code, cx, cy, cz FROM celled")
def pose_cell(spark, sf_dir):
    return apart_poses(spark, sf_dir).select("vote_code", *poses.CELL)


@query(SCORES + "SELECT vote_code, score FROM scored")
def pose_cluster_l2(spark, sf_dir):
    return poses.neighbour_scores(apart_poses(spark, sf_dir), None).select("vote_code", "score")


@query(QUATS + f", {CELLS}, {scores_sql(True)} SELECT vote_code, score FROM scored")
def pose_cluster_cellwise(spark, sf_dir):
    return poses.neighbour_scores(apart_poses(spark, sf_dir), None, any_distance=True).select("vote_code", "score")


@query(SCORES + f"SELECT vote_code, score, {s6('ax')} AS ax, {s6('ay')} AS ay, {s6('az')} AS az FROM scored")
def pose_cluster_avg(spark, sf_dir):
    return rounded(poses.neighbour_scores(apart_poses(spark, sf_dir), None).select("vote_code", "score", "ax", "ay", "az"), "ax", "ay", "az")


_T = [[0.36, 0.48, -0.8, 0.5], [-0.8, 0.6, 0.0, -0.25], [0.48, 0.64, 0.6, 1.0]]
_PUT = [*(" + ".join(f"{_T[r][k]} * {c}" for k, c in enumerate("xyz")) + f" + {_T[r][3]}" for r in range(3)), *(" + ".join(f"{_T[r][k]} * n{c}" for k, c in enumerate("xyz")) for r in range(3))]
MANY = votes_sql("scene AS (SELECT cloud_id, pt_id, " + ", ".join(f"{e} AS {c}" for e, c in zip(_PUT, clouds.FIELDS)) + " FROM cloud)").replace(MODEL, MODELS)
BEST = f"WITH {MANY}, {poses_sql()}, {quaternion_sql()}, {CELLS}, {scores_sql()}, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY scene_id, model_id ORDER BY score DESC, cnt DESC, vote_code) = 1) "


def _best(spark, sf_dir, options: registration.Options = registration.Options()) -> DataFrame:
    """Every cloud as a model in every cloud as a scene; scenes are moved, as translations of 0 lie on a corner of cells."""
    c = cloud(spark, sf_dir)
    return registration.register(clouds.transformed(c, rigid.literal(_T)), c, options)


@query(BEST + f"SELECT scene_id, model_id, score, {MATRIX6} FROM best")
def best_pose(spark, sf_dir):
    return rounded(_best(spark, sf_dir), *rigid.NAMES)


_TAUS = {0: 0.05, 1: 0.1}
_TWO = f"CASE cloud_id WHEN 0 THEN {_TAUS[0]} ELSE {_TAUS[1]} END"
TWO = votes_sql(APART.replace("<> 0", "> 1")).replace(MODEL, "model AS (SELECT * FROM cloud WHERE cloud_id <= 1)").replace(f"{TAU!r} * {EXTENT}", f"{_TWO} * {EXTENT}")


@query(f"WITH {TWO} SELECT model_id, s_r, m_r, alpha, cnt FROM votes")
def votes_by_own_step(spark, sf_dir):
    """Two models, each with a step of its own share of its extent."""
    c = cloud(spark, sf_dir)
    models = c.filter("cloud_id <= 1")
    scene = c.filter("cloud_id > 1").withColumn("cloud_id", F.lit(100))
    return registration.found_votes(scene, models, registration.model_steps(models, _TAUS)).select("model_id", "s_r", "m_r", "alpha", "cnt")


def greedy_sql(quats: str, rotation: float = D) -> str:
    """Of the view quat, one seed after another: the strongest pose that is left, and what is near it goes with it."""
    mine, seeds = ("p.", "s.")
    gap = " + ".join(f"({mine}{c} - {seeds}{c}) * ({mine}{c} - {seeds}{c})" for c in poses.MOVE)
    turn = " + ".join(f"{mine}{c} * {seeds}{c}" for c in poses.QUATERNION)
    q = ", ".join(f"avg(CASE WHEN {' + '.join(f'a.{x} * s.{x}' for x in poses.QUATERNION)} < 0 THEN -a.{c} ELSE a.{c} END) AS {c}" for c in poses.QUATERNION)
    size = "sqrt(" + " + ".join(f"{c} * {c}" for c in poses.QUATERNION) + ")"
    return f"""{quats.replace('WITH ', 'WITH RECURSIVE ', 1)},
o AS MATERIALIZED (SELECT scene_id, model_id, cnt, tx, ty, tz, qw, qx, qy, qz, d_dist, row_number() OVER (PARTITION BY scene_id, model_id ORDER BY cnt DESC, vote_code) AS k FROM quat),
g AS (
  SELECT 0 AS turn, * FROM o UNION ALL
  SELECT p.turn + 1, p.* EXCLUDE (turn, first) FROM (SELECT *, min(k) OVER (PARTITION BY scene_id, model_id) AS first FROM g) p JOIN o s ON s.scene_id = p.scene_id AND s.model_id = p.model_id AND s.k = p.first
  WHERE p.k <> p.first AND NOT (sqrt({gap}) < p.d_dist AND 2 * acos(least(1.0, abs({turn}))) < {rotation!r})),
a AS (SELECT scene_id, model_id, k, max(turn) AS c FROM g GROUP BY ALL),
m AS (SELECT o.*, c, min(k) OVER (PARTITION BY scene_id, model_id, c) AS first FROM a JOIN o USING (scene_id, model_id, k)),
t AS (SELECT a.scene_id, a.model_id, a.first, CAST(sum(a.cnt) AS BIGINT) AS votes, count(*) AS n_poses, avg(a.tx) AS tx, avg(a.ty) AS ty, avg(a.tz) AS tz, {q} FROM m a JOIN o s ON s.scene_id = a.scene_id AND s.model_id = a.model_id AND s.k = a.first GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, model_id ORDER BY votes DESC, first) AS rank FROM t)
SELECT scene_id, model_id, rank, votes, n_poses, {", ".join(f"{s6(c)} AS {c}" for c in poses.MOVE)}, {", ".join(f"{s6(f'{c} / {size}')} AS {c}" for c in poses.QUATERNION)} FROM r WHERE rank <= 3"""


@query(greedy_sql(QUATS))
def greedy_cluster(spark, sf_dir):
    m = model(spark, sf_dir)
    d_dist = registration.model_steps(m, TAU).first()["d_dist"]
    out = poses.greedy_clusters(apart_poses(spark, sf_dir), d_dist)
    return rounded(out, *poses.MOVE, *poses.QUATERNION)


#: Just over the step of the angles: poses that differ by one step only would be near or not by rounding.
_TURN = 0.21


@query(greedy_sql(f"WITH {MANY}, {poses_sql()}, {quaternion_sql()}", _TURN))
def greedy_clusters_of_all(spark, sf_dir):
    """Every cloud as a model in every cloud as a scene, moved as those of best_pose are."""
    c = cloud(spark, sf_dir)
    scenes, steps = clouds.transformed(c, rigid.literal(_T)), registration.model_steps(c, TAU)
    votes = voting.pruned(stored(registration.found_votes(scenes, c, steps, threshold=THRESHOLD)), THRESHOLD)
    out = poses.greedy_clusters(registration.vote_poses(votes, scenes, c, steps), rotation=_TURN)
    return rounded(out, *poses.MOVE, *poses.QUATERNION)


TRUTH = "truth AS (SELECT scene_id, model_id, cos(a) AS g11, -sin(a) AS g12, 0.0 AS g13, 0.1 AS g14, sin(a) AS g21, cos(a) AS g22, 0.0 AS g23, 0.2 AS g24, 0.0 AS g31, 0.0 AS g32, 1.0 AS g33, 0.3 AS g34 FROM (SELECT s.cloud_id AS scene_id, m.cloud_id AS model_id, (s.cloud_id + m.cloud_id) / 10.0 AS a FROM (SELECT DISTINCT cloud_id FROM cloud) s, (SELECT DISTINCT cloud_id FROM cloud) m))"
ERRORS = BEST + f", {TRUTH}, err AS (SELECT t.scene_id, t.model_id, sqrt((t14 - g14) * (t14 - g14) + (t24 - g24) * (t24 - g24) + (t34 - g34) * (t34 - g34)) AS trans_err, (t11 * g11 + t12 * g12 + t13 * g13 + t21 * g21 + t22 * g22 + t23 * g23 + t31 * g31 + t32 * g32 + t33 * g33 - 1) / 2 AS c FROM truth t LEFT JOIN best USING (scene_id, model_id)) "


def _truth(spark, sf_dir) -> DataFrame:
    c = cloud(spark, sf_dir).select("cloud_id").distinct()
    scenes, models = c.withColumnRenamed("cloud_id", "scene_id"), c.withColumnRenamed("cloud_id", "model_id")
    pairs_ = scenes.crossJoin(models)  # a true pose for each scene and model
    t = rigid.rotz((F.col("scene_id") + F.col("model_id")) / 10.0), V.literal(0.1, 0.2, 0.3)
    return pairs_.select("scene_id", "model_id", *[c.alias(n) for n, c in rigid.to_columns(t).items()])


@query(ERRORS + f"SELECT scene_id, model_id, {s6('trans_err')} AS trans_err, {s6('acos(' + clamp_sql('c') + ')')} AS rot_err FROM err")
def pose_distance(spark, sf_dir):
    return rounded(poses.compared(_best(spark, sf_dir), _truth(spark, sf_dir)), "trans_err", "rot_err")


@query(ERRORS + f", diam AS (SELECT cloud_id AS model_id, {EXTENT} AS diam FROM cloud GROUP BY ALL), m AS (SELECT scene_id, model_id, coalesce(trans_err < 8.0 * diam, FALSE) AS trans_match, coalesce(acos({clamp_sql('c')}) < radians(120.0), FALSE) AS rot_match FROM err JOIN diam USING (model_id)) SELECT *, trans_match AND rot_match AS match FROM m")
def validation_match(spark, sf_dir):
    errors = poses.compared(_best(spark, sf_dir), _truth(spark, sf_dir))
    diam = registration.model_steps(cloud(spark, sf_dir), TAU)
    return poses.validated(errors, diam, 8.0, 120.0).select("scene_id", "model_id", "trans_match", "rot_match", "match")


# ---- evaluation

EVENTS = "e AS (SELECT event_id, event_type AS model, value AS occlusion, (value * 37) % 10 AS trans, (value * 13) % 6.5 AS rot FROM events)"


def _events(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), v.alias("occlusion"), ((v * 37) % 10).alias("trans"), ((v * 13) % 6.5).alias("rot"))


def _flags(spark, sf_dir) -> DataFrame:
    rows = _events(spark, sf_dir)
    sizes = rows.select("model").distinct().withColumn("diam", F.length("model") * 2.0)
    return evaluation.flagged(rows, sizes, 0.3, 3.0)


FLAGS = f"WITH {EVENTS}, f AS (SELECT *, trans / (length(model) * 2.0) AS norm_dist, CASE WHEN rot <= 3.141592653589793 THEN rot ELSE 2 * 3.141592653589793 - rot END AS rot_folded, (trans <= 0.3 * (length(model) * 2.0)) AND rot <= 3.0 AS match FROM e) "


@query(FLAGS + "SELECT event_id, match, round(avg(CAST(match AS INT)) OVER (ORDER BY occlusion, event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS rate FROM f")
def occlusion_running_match(spark, sf_dir):
    out = evaluation.running_rate(_flags(spark, sf_dir), ["occlusion", "event_id"])
    return rounded(out.select("event_id", "match", "rate"), "rate")


@query(FLAGS + "SELECT model, " + ", ".join(f"round({f}({c}), 6) + 0.0 AS {n}_{c}" for c in ("norm_dist", "rot_folded") for n, f in (("mean", "avg"), ("median", "median"))) + " FROM f GROUP BY ALL")
def error_mean_median(spark, sf_dir):
    names = [f"{n}_{c}" for c in ("norm_dist", "rot_folded") for n in ("mean", "median")]
    return rounded(evaluation.error_summary(_flags(spark, sf_dir), ["norm_dist", "rot_folded"], ["model"]), *names)


@query(FLAGS + f"SELECT event_id, {s6('rot_folded')} AS rot_folded FROM f")
def angle_fold(spark, sf_dir):
    return rounded(_flags(spark, sf_dir).select("event_id", "rot_folded"), "rot_folded")


@query(FLAGS + f"SELECT event_id, {s6('norm_dist')} AS norm_dist FROM f WHERE occlusion <= 80 AND norm_dist <= 0.5")
def error_filter(spark, sf_dir):
    return rounded(evaluation.near_enough(_flags(spark, sf_dir), 80.0, 0.5).select("event_id", "norm_dist"), "norm_dist")


_NAMED = "CASE event_id % 4 WHEN 0 THEN 'cheff' WHEN 1 THEN 'T-rex' WHEN 2 THEN 'parasaurolophus' ELSE event_type END"


@query(f"SELECT event_id, CASE n WHEN 'cheff' THEN 'chef' WHEN 'T-rex' THEN 'trex' WHEN 'parasaurolophus' THEN 'para' ELSE n END AS name FROM (SELECT event_id, {_NAMED} AS n FROM events)")
def name_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", model_name(F.expr(_NAMED)).alias("name"))


_LINE = "CASE WHEN event_id % 5 = 0 THEN '[d t]: Transformations for models/' || (CASE event_id % 4 WHEN 0 THEN 'cheff' WHEN 1 THEN 'T-rex' ELSE event_type END) || '_high.ply in s.ply:' WHEN event_id % 5 = 3 THEN 'other' ELSE '[t]: x Distance (trans, rot): ' || CAST(event_id % 7 AS VARCHAR) || '.5, ' || CAST(event_id % 11 AS VARCHAR) || '.25' END"


@query(f"WITH l AS (SELECT 'rs' || CAST(user_id % 10 AS VARCHAR) || '_run.txt' AS file, event_id AS line_no, event_id % 5 AS k, event_id % 4 AS m, event_type, event_id % 7 + 0.5 AS trans, event_id % 11 + 0.25 AS rot, CAST(user_id % 10 AS VARCHAR) AS scene_num FROM events), n AS (SELECT *, last_value(CASE WHEN k = 0 THEN CASE m WHEN 0 THEN 'chef' WHEN 1 THEN 'trex' ELSE string_split(event_type, '_')[1] END END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS model FROM l) SELECT file, line_no, scene_num, model, CAST(trans AS DOUBLE) AS trans, CAST(rot AS DOUBLE) AS rot FROM n WHERE k NOT IN (0, 3)")
def log_parse_ffill(spark, sf_dir):
    line = F.expr(_LINE.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("rs"), F.col("user_id") % 10, F.lit("_run.txt")).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return texts.parse_log(rows)


# ---- scenes and meshes

_MOVED = ", ".join(f"{s6(' + '.join(f'{_T[r][k]} * {c}' for k, c in enumerate('xyz')) + f' + {_T[r][3]}')} AS {'xyz'[r]}" for r in range(3))
_TURNED = ", ".join(f"{s6(' + '.join(f'{_T[r][k]} * n{c}' for k, c in enumerate('xyz')))} AS n{'xyz'[r]}" for r in range(3))


@query(f"WITH {CLOUD} SELECT cloud_id, pt_id, {_MOVED}, {_TURNED} FROM cloud")
def transform_cloud(spark, sf_dir):
    return rounded(clouds.transformed(cloud(spark, sf_dir), rigid.literal(_T)), *clouds.FIELDS)


@query(f"WITH {CLOUD}, {MODEL}, u AS (SELECT x, y, z FROM cloud WHERE cloud_id <> 0 UNION ALL SELECT {_MOVED} FROM model) SELECT count(*) AS n, {s6('sum(x)')} AS x, {s6('sum(y)')} AS y, {s6('sum(z)')} AS z FROM u")
def union_scene(spark, sf_dir):
    put = rounded(clouds.transformed(model(spark, sf_dir), rigid.literal(_T)), "x", "y", "z").select("x", "y", "z")
    u = cloud(spark, sf_dir).filter("cloud_id <> 0").select("x", "y", "z").unionByName(put)
    return u.agg(F.count("*").alias("n"), *[r6(F.sum(c)).alias(c) for c in "xyz"])


_QT = (0.5, 0.5, 0.5, 0.5)


@query(f"WITH {CLOUD}, {MODEL}, mc AS (SELECT avg(x) AS a, avg(y) AS b, avg(z) AS c FROM model), sc AS (SELECT avg(x) AS d, avg(y) AS e, avg(z) AS f FROM cloud WHERE cloud_id <> 0) SELECT pt_id, FALSE AS added, {s6('x')} AS x, {s6('y')} AS y, {s6('z')} AS z FROM cloud WHERE cloud_id <> 0 UNION ALL SELECT pt_id, TRUE, {s6('z + d + 0.3 - c')}, {s6('x + e + 0.2 - a')}, {s6('y + f + 0.1 - b')} FROM model, mc, sc")
def synth_scene(spark, sf_dir):
    out, _ = synthesis.scene_with_model(cloud(spark, sf_dir).filter("cloud_id <> 0"), model(spark, sf_dir), (0.3, 0.2, 0.1), _QT)
    return rounded(out.select("pt_id", "added", "x", "y", "z"), "x", "y", "z")


def _faces(spark, sf_dir) -> DataFrame:
    """Polygons of three to five corners, made of the points' numbers."""
    p, n = F.col("pt_id"), cloud(spark, sf_dir).count()
    size = (3 + p % 3).cast("int")
    v = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.pmod(p + k * k * 7 + k, F.lit(n)))
    return cloud(spark, sf_dir).select(F.lit(1).alias("cloud_id"), p.alias("face_id"), v.alias("vertex_indices"))


FANS = f"{CLOUD}, size AS (SELECT count(*) AS s FROM cloud), fans AS (SELECT pt_id AS face_id, k AS part, pt_id % s AS v1, (pt_id + k * k * 7 + k) % s AS v2, (pt_id + (k + 1) * (k + 1) * 7 + k + 1) % s AS v3 FROM cloud, size, (SELECT unnest(range(1, 4)) AS k) WHERE k <= 1 + pt_id % 3)"


@query(f"WITH {FANS} SELECT face_id, part, v1, v2, v3 FROM fans")
def fan_triangulate(spark, sf_dir):
    return meshes.fan_triangles(_faces(spark, sf_dir)).drop("cloud_id")


@query(f"WITH {FANS}, t AS (SELECT v1, v2, v3, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM fans JOIN cloud a ON v1 = a.pt_id JOIN cloud b ON v2 = b.pt_id JOIN cloud c ON v3 = c.pt_id), n AS (SELECT v1, v2, v3, uy * vz - uz * vy AS p, uz * vx - ux * vz AS q, ux * vy - uy * vx AS r FROM t), w AS (SELECT unnest([v1, v2, v3]) AS pt_id, p / sqrt(p * p + q * q + r * r) AS p, q / sqrt(p * p + q * q + r * r) AS q, r / sqrt(p * p + q * q + r * r) AS r FROM n WHERE p <> 0 OR q <> 0 OR r <> 0), s AS (SELECT pt_id, sum(p) AS p, sum(q) AS q, sum(r) AS r FROM w GROUP BY ALL) SELECT pt_id, {s6('p / sqrt(p * p + q * q + r * r)')} AS nx, {s6('q / sqrt(p * p + q * q + r * r)')} AS ny, {s6('r / sqrt(p * p + q * q + r * r)')} AS nz FROM s")
def vertex_normals(spark, sf_dir):
    triangles = meshes.fan_triangles(_faces(spark, sf_dir))
    vertices = cloud(spark, sf_dir).withColumn("cloud_id", F.lit(1))
    return rounded(meshes.vertex_normals(triangles, vertices).drop("cloud_id"), "nx", "ny", "nz")


MESHES = f"""{CLOUD}, v AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY pt_id) - 1 AS p, count(*) OVER (PARTITION BY cloud_id) AS s FROM cloud),
tri AS (SELECT cloud_id, p % s AS v1, (p + k * k * 7 + k) % s AS v2, (p + (k + 1) * (k + 1) * 7 + k + 1) % s AS v3 FROM v, (SELECT unnest(range(1, 4)) AS k) WHERE k <= 1 + p % 3),
t AS (SELECT cloud_id, v1, v2, v3, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz FROM tri JOIN v a USING (cloud_id) JOIN v b USING (cloud_id) JOIN v c USING (cloud_id) WHERE v1 = a.p AND v2 = b.p AND v3 = c.p),
n AS (SELECT cloud_id, v1, v2, v3, uy * vz - uz * vy AS p, uz * vx - ux * vz AS q, ux * vy - uy * vx AS r FROM t),
w AS (SELECT cloud_id, unnest([v1, v2, v3]) AS pt_id, p / sqrt(p * p + q * q + r * r) AS p, q / sqrt(p * p + q * q + r * r) AS q, r / sqrt(p * p + q * q + r * r) AS r FROM n WHERE p <> 0 OR q <> 0 OR r <> 0),
normal AS (SELECT cloud_id, pt_id, p / sqrt(p * p + q * q + r * r) AS nx, q / sqrt(p * p + q * q + r * r) AS ny, r / sqrt(p * p + q * q + r * r) AS nz FROM (SELECT cloud_id, pt_id, sum(p) AS p, sum(q) AS q, sum(r) AS r FROM w GROUP BY ALL))"""


def _meshes(spark, sf_dir) -> str:
    """A folder of a mesh file for each cloud, of polygons of three to five corners."""
    folder = _place(spark, "meshes")
    v = clouds.numbered(cloud(spark, sf_dir), span=clouds.SPAN).withColumn("pt_id", F.col("position"))
    v = lookup(v, clouds.sizes(v), ["cloud_id"])
    p, corners = F.col("pt_id"), (F.col("pt_id") % 3).cast("int") + 2
    f = v.select("cloud_id", p.alias("face_id"), F.transform(F.sequence(F.lit(0), corners), lambda k: F.pmod(p + k * k * 7 + k, F.col("n"))).alias("vertex_indices"))
    ply.write_meshes(v.select("cloud_id", "pt_id", *clouds.POINT), f, folder)
    return folder


@query(f"WITH {MESHES} SELECT CAST(cloud_id AS VARCHAR) AS cloud_id, pt_id, {s6('nx')} AS nx, {s6('ny')} AS ny, {s6('nz')} AS nz FROM normal")
def mesh_normals(spark, sf_dir):
    """Normals of the vertices of many mesh files, read in one pass."""
    out = files.mesh_cloud(spark, _meshes(spark, sf_dir)).dropna(subset=["nx"])
    return rounded(out.select("cloud_id", "pt_id", *clouds.NORMAL), *clouds.NORMAL)


@query(f"WITH {MESHES} SELECT CAST(cloud_id AS VARCHAR) AS cloud_id, p AS pt_id, {s6('x - avg(x) OVER own + 1')} AS x, {s6('y - avg(y) OVER own')} AS y, {s6('z - avg(z) OVER own + 2')} AS z, {s6('coalesce(normal.nx, 0)')} AS nx FROM v LEFT JOIN normal ON v.cloud_id = normal.cloud_id AND p = normal.pt_id WINDOW own AS (PARTITION BY v.cloud_id) QUALIFY p % 5 = 0".replace("SELECT CAST(cloud_id", "SELECT CAST(v.cloud_id"))
def mesh_clouds(spark, sf_dir):
    """Every fifth vertex of many mesh files, centred and moved, with normals: written as mesh files again, and read."""
    rows = clouds.centered(files.mesh_cloud(spark, _meshes(spark, sf_dir)))
    rows = clouds.every_nth(rows, 5).fillna(0.0, list(clouds.NORMAL)).withColumns({"x": F.col("x") + 1, "z": F.col("z") + 2})
    folder = _place(spark, "thinned")
    rows = stored(rows)
    ply.write_meshes(rows.select("cloud_id", "pt_id", *clouds.FIELDS), rows.select("cloud_id", F.lit(0).cast("long").alias("face_id"), F.array(F.lit(0)).alias("vertex_indices")).limit(0), folder)
    back = ply.read_cloud(spark, folder).withColumn("pt_id", 5 * F.col("pt_id"))
    return rounded(back.select("cloud_id", "pt_id", "x", "y", "z", "nx"), "x", "y", "z", "nx")


def _place(spark: SparkSession, name: str) -> str:
    """A path in the folder that executors share; it is deleted with the stored tables."""
    head, dot, kind = name.partition(".")
    return kept(spark, f"{shared_folder(spark)}/{head}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}{dot}{kind}")


@query(f"WITH {CLOUD} SELECT row_number() OVER (ORDER BY pt_id) - 1 AS row, {', '.join(clouds.FIELDS)}, cloud_id AS label FROM cloud")
def ply_roundtrip(spark, sf_dir):
    """The clouds, written to a file in the folder that executors share and read again."""
    path = _place(spark, "clouds.ply")
    rows = cloud(spark, sf_dir).select("pt_id", *clouds.FIELDS, F.col("cloud_id").alias("label"))
    ply.write({"vertex": rows}, path, "binary_little_endian", doubles=True, order={"vertex": "pt_id"})
    return ply.read(spark, path).drop("file")


@query(f"WITH {CLOUD}, g AS (SELECT CAST(floor(x / 0.2) AS BIGINT) AS c0, CAST(floor(y / 0.2) AS BIGINT) AS c1, CAST(floor(z / 0.2) AS BIGINT) AS c2, " + ", ".join(f"avg({c}) AS {c}" for c in clouds.FIELDS) + ", floor(avg(cloud_id)) AS label FROM cloud GROUP BY ALL) SELECT row_number() OVER (ORDER BY c2, c1, c0) - 1 AS row, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in clouds.FIELDS) + ", CAST(label AS BIGINT) AS label FROM g")
def voxel_file(spark, sf_dir):
    """A file's points, thinned by a voxel grid into another file, and that one read."""
    a, b = _place(spark, "points.ply"), _place(spark, "thinned.ply")
    rows = cloud(spark, sf_dir).select("pt_id", *clouds.FIELDS, F.col("cloud_id").alias("label"))
    ply.write({"vertex": rows}, a, "binary_little_endian", doubles=True, order={"vertex": "pt_id"})
    files.thin_file(spark, a, b, 0.2)
    out = ply.read(spark, b).drop("file").withColumn("label", F.col("label").cast("long"))
    return out.withColumns({c: F.round(F.col(c).cast("double"), 4) + F.lit(0.0) for c in clouds.FIELDS})


@query(f"WITH {CLOUD} SELECT row_number() OVER (ORDER BY pt_id) - 1 AS row, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS c{k}" for k, c in enumerate(clouds.FIELDS)) + " FROM cloud")
def raw_floats(spark, sf_dir):
    """Points and normals as raw 32-bit floats in a file, and read again."""
    path = _place(spark, "floats.bin")
    texts.write_floats(cloud(spark, sf_dir), list(clouds.FIELDS), "pt_id", path)
    out = texts.read_floats(spark, path, 6).drop("file")
    return out.withColumns({c: r6(F.col(c).cast("double")) for c in out.columns if c != "row"})


_CELLS16 = [f"n_nationkey * {k + 1} / 8.0" for k in range(12)]


@query("SELECT " + ", ".join(f"{e} AS {n}" for e, n in zip(_CELLS16, rigid.NAMES)) + " FROM nation")
def matrix_files(spark, sf_dir):
    """A file of sixteen numbers for each nation, and all of them read."""
    path = _place(spark, "matrices")
    rows = [F.concat_ws(" ", *[F.expr(e).cast("string") for e in _CELLS16[4 * r : 4 * r + 4]]) for r in range(3)]
    text = F.concat_ws("\n", *rows, F.lit("0 0 0 1"))
    table(spark, sf_dir, "nation").select("n_nationkey", text.alias("value")).coalesce(1).write.partitionBy("n_nationkey").text(path)
    return texts.read_matrices(spark, path).drop("file")


@query(f"WITH {CLOUD}, low AS (SELECT cloud_id, min(x) AS x, min(y) AS y, min(z) AS z FROM cloud GROUP BY ALL) SELECT " + ", ".join(f"{s6(f'greatest(0.0, max(abs({a}) + 1))')} AS t{a}" for a in "xyz") + " FROM low")
def trans_adj_sidecar(spark, sf_dir):
    path = _place(spark, "cloud.ply.trans_adj")
    texts.write_shift(clouds.shift_to_positive(cloud(spark, sf_dir)), path)
    v = F.split(F.trim("value"), " ")
    return rounded(spark.read.text(path).select(*[v[k].cast("double").alias(n) for k, n in enumerate(("tx", "ty", "tz"))]), "tx", "ty", "tz")


@query(f"WITH {CLOUD}, moved AS (SELECT pt_id, {', '.join(f'{e} AS {c}' for e, c in zip(_PUT, clouds.FIELDS))} FROM cloud) SELECT " + ", ".join(f"{s6(f'max(abs(a.{c} - b.{c}))')} AS {c}" for c in "xyz") + " FROM cloud a JOIN moved b USING (pt_id)")
def largest_difference(spark, sf_dir):
    c = cloud(spark, sf_dir)
    return rounded(texts.largest_difference(c, clouds.transformed(c, rigid.literal(_T)), ["pt_id"], list("xyz")), "x", "y", "z")


@query(POSES + "SELECT vote_code, FALSE AS mirrored FROM pose")
def proper_poses(spark, sf_dir):
    """Of poses and their mirror images, those that don't mirror."""
    p = apart_poses(spark, sf_dir)
    flipped = p.withColumns({n: -F.col(n) for n in ("t11", "t21", "t31")})
    both = p.withColumn("mirrored", F.lit(False)).unionByName(flipped.withColumn("mirrored", F.lit(True)))
    return poses.proper(both).select("vote_code", "mirrored")


@query(QUATS + ", d AS (SELECT *, tx / d_dist AS x, ty / d_dist AS y, tz / d_dist AS z FROM quat) SELECT vote_code, CAST(trunc(x) AS BIGINT) AS cx, CAST(trunc(y) AS BIGINT) AS cy, CAST(trunc(z) AS BIGINT) AS cz FROM d")
def pose_cell_truncated(spark, sf_dir):
    return poses.cells(apart_poses(spark, sf_dir).drop(*poses.CELL), F.col("d_dist"), truncate=True).select("vote_code", *poses.CELL)


# A log for each of fifty scenes; their models are the four of the evaluation. A pair's first distance counts; every
# fifth event has none.
_MODEL = "CASE event_id % 4 WHEN 0 THEN 'chef' WHEN 1 THEN 'trex' WHEN 2 THEN 'para' ELSE 'chicken' END"
_LOGGED = "CASE event_id % 4 WHEN 0 THEN 'cheff' WHEN 1 THEN 'T-rex' WHEN 2 THEN 'parasaurolophus' ELSE 'chicken' END"
_DIAM = "CASE model " + " ".join(f"WHEN '{m}' THEN {d!r}" for m, d in evaluation.MODEL_DIAMETERS.items()) + " END"
RUN = f"""pair AS (SELECT CAST(user_id % 50 AS VARCHAR) AS scene_num, {_MODEL} AS model, * EXCLUDE (user_id) FROM events),
first AS (SELECT scene_num, model, event_id % 97 + 0.5 AS trans, (event_id % 13) / 4.0 AS rot FROM pair WHERE event_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY scene_num, model ORDER BY event_id) = 1),
run AS (SELECT scene_num, model, value AS occlusion, trans, rot, {_DIAM} AS diam FROM pair JOIN first USING (scene_num, model)),
flags AS (SELECT *, trans / diam AS norm_dist, CASE WHEN rot <= pi() THEN rot ELSE 2 * pi() - rot END AS rot_folded, trans <= 0.3 * diam AND rot <= 0.209440 AS match FROM run)"""


def _run_files(spark, sf_dir) -> tuple[str, str]:
    """An occlusion table of a line for each event, which all tasks write, and a folder of logs."""
    e = table(spark, sf_dir, "events")
    occlusion, logs = _place(spark, "occlusion.txt"), _place(spark, "logs")
    rows = e.selectExpr("event_id", f"concat_ws(' ', user_id % 50, {_MODEL}, value) AS line")
    body = sink.bodies(rows.orderBy("event_id").select("line"), lambda b: "".join(x + "\n" for x in b.column(0).to_pylist()).encode())
    sink.write_file(spark, occlusion, b"scene model occlusion\n", [body])
    told = e.selectExpr(
        "concat('rs', user_id % 50, '_log') AS name",
        "event_id",
        f"explode(array(named_struct('k', 0, 'line', concat('[d t]: Transformations for a/b/', {_LOGGED}, '_high.ply in s.ply:')), named_struct('k', 1, 'line', if(event_id % 5 = 0, 'no pose', concat('[d t]: Distance (trans, rot): ', event_id % 97, '.5, ', (event_id % 13) / 4.0))))) AS told",
    )
    sink.write_named_lines(told.selectExpr("name", "2 * event_id + told.k AS line_no", "told.line AS line"), logs)
    return occlusion, logs


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, 'line ' || CAST(event_id AS VARCHAR) AS line FROM events")
def split_lines(spark, sf_dir):
    """A line for each event in one file that all tasks write, and its lines read by ranges, with their numbers."""
    path = _place(spark, "lines.txt")
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "concat('line ', event_id) AS line").orderBy("event_id")
    sink.write_file(spark, path, b"", [sink.bodies(rows.select("line"), lambda b: "".join(x + "\n" for x in b.column(0).to_pylist()).encode())])
    return texts.lines(spark, path).drop("file")


@query(f"WITH l AS (SELECT event_id AS line_no, event_id % 5 AS k, event_id % 4 AS m, event_type, event_id % 7 + 0.5 AS trans, event_id % 11 + 0.25 AS rot FROM events), n AS (SELECT *, last_value(CASE WHEN k = 0 THEN CASE m WHEN 0 THEN 'chef' WHEN 1 THEN 'trex' ELSE string_split(event_type, '_')[1] END END IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS model FROM l) SELECT line_no, model, CAST(trans AS DOUBLE) AS trans, CAST(rot AS DOUBLE) AS rot FROM n WHERE k NOT IN (0, 3)")
def log_of_all_events(spark, sf_dir):
    """One log of all events: models are carried over its spans."""
    line = F.expr(_LINE.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "events").select(F.lit("rs1_run.txt").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return texts.parse_log(rows).drop("file", "scene_num")


def _evaluated(spark, sf_dir) -> DataFrame:
    return files.evaluated(spark, *_run_files(spark, sf_dir))


@query(f"WITH {RUN} SELECT scene_num, model, occlusion, trans, rot, {s6('norm_dist')} AS norm_dist, match, round(avg(CAST(match AS INT)) OVER (ORDER BY occlusion, scene_num, model ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS rate FROM flags")
def evaluated_run(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir).drop("rot_folded"), "norm_dist", "rate")


@query(f"WITH {RUN} SELECT count(*) AS n, {s6('avg(CAST(match AS INT))')} AS match_rate, " + ", ".join(f"{s6(f'{f}({c})')} AS {n}_{c}" for c in ("norm_dist", "rot_folded") for n, f in (("mean", "avg"), ("median", "median"))) + " FROM flags")
def evaluation_report(spark, sf_dir):
    out = files.report(files.flagged(spark, *_run_files(spark, sf_dir)))
    return rounded(out, *[c for c in out.columns if c != "n"])


_KNOWN, _KNOWN_AT = synthesis.random_quaternion(11), (0.3, 0.2, 0.1)


def _turn_of(w: float, x: float, y: float, z: float) -> list[list[float]]:
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


_R = _turn_of(*_KNOWN)
_TRUE = [f"{s6(f'CAST({_R[r][k]!r} AS DOUBLE)')} AS t{r + 1}{k + 1}" for r in range(3) for k in range(3)] + [s6(f"s{a} + {_KNOWN_AT[r]} - ({' + '.join(f'{_R[r][k]!r} * m{b}' for k, b in enumerate('xyz'))})") + f" AS t{r + 1}4" for r, a in enumerate("xyz")]


@query(f"WITH {CLOUD}, m AS (SELECT " + ", ".join(f"avg({a}) AS m{a}" for a in "xyz") + ", " + EXTENT + " AS diam FROM cloud WHERE cloud_id = 0), s AS (SELECT " + ", ".join(f"avg({a}) AS s{a}" for a in "xyz") + f" FROM cloud WHERE cloud_id <> 0) SELECT 100 AS scene_id, 0 AS model_id, TRUE AS match, {s6('0.1 * diam')} AS allowed, {', '.join(_TRUE)} FROM m, s")
def known_pose(spark, sf_dir):
    """A model put into a scene at a known pose: that pose, how far from it an answer may be, and whether the pose
    that is found is near enough."""
    m = model(spark, sf_dir)
    rest = cloud(spark, sf_dir).filter("cloud_id <> 0")
    scene, t = synthesis.scene_with_model(rest, m, _KNOWN_AT, _KNOWN)
    scene = scene.withColumn("cloud_id", F.lit(100))
    found = registration.register(scene, m)
    truth = spark.range(1).select(F.lit(100).alias("scene_id"), F.lit(0).alias("model_id"), *[c.alias(n) for n, c in rigid.to_columns(t).items()])
    steps = registration.model_steps(m, TAU)
    checked = poses.validated(poses.compared(found, truth), steps).select("scene_id", "model_id", "match")
    out = truth.join(checked, voting.PAIR).join(steps.select("model_id", (0.1 * F.col("diam")).alias("allowed")), "model_id")  # a row each
    return rounded(out, "allowed", *rigid.NAMES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest votes of the scene of all points for one model."""
    return voting.ranked(voting.pruned(stored(all_votes(spark, sf_dir, threshold=THRESHOLD)), THRESHOLD), 100)


