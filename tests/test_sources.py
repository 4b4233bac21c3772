import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from quillstone import cli
from quillstone.functions import hashing, rigid
from quillstone.functions.rigid import NAMES
from quillstone.operators import clouds, evaluation, fills, meshes
from quillstone.plans import catalogue, files, registration
from quillstone.sources import ply, ranges, texts

CUBE = """ply
format ascii 1.0
comment a cube
element vertex 4
property float x
property float y
property float z
element face 2
property list uchar int vertex_indices
end_header
0 0 0
1 0 0
1 1 0
0 1 0
4 0 1 2 3
3 0 1 2
"""


def test_ascii_mesh(spark, tmp_path):
    path = tmp_path / "cube.ply"
    path.write_text(CUBE)
    v = ply.read_cloud(spark, str(path)).orderBy("pt_id").collect()
    assert [(r["x"], r["y"], r["nx"]) for r in v] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)] and v[0]["cloud_id"] == "cube"
    t = meshes.fan_triangles(ply.read_faces(spark, str(path))).orderBy("face_id", "part").collect()
    assert [(r["v1"], r["v2"], r["v3"]) for r in t] == [(0, 1, 2), (0, 2, 3), (0, 1, 2)]
    assert ply.headers(spark, str(path)).first()["comments"] == ["a cube"]


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_round_trip(spark, tmp_path, form):
    path = str(tmp_path / "t.ply")
    rows = [(k, k / 8.0, -k, [k, 300, 7][: 1 + k % 3]) for k in range(7)]
    df = spark.createDataFrame(rows, "n int, d double, i long, l array<int>")
    ply.write({"thing": df}, path, form, doubles=True, order={"thing": "n"})
    back = ply.read(spark, path, "thing").orderBy("row").collect()
    assert [(r["d"], r["i"], r["l"]) for r in back] == [(d, i, x) for _, d, i, x in rows]
    kinds = ply.parse_header(open(path, "rb").read()).elements[0].properties
    assert [(p.kind, p.count) for p in kinds] == [("f8", None), ("i1", None), ("i2", "u1")]


@pytest.mark.parametrize("bad", ["plx\n", "ply\nformat ascii 2.0\nend_header\n", "ply\nformat text 1.0\nend_header\n", "ply\nformat ascii 1.0\nelement a 1\nelement a 2\nend_header\n", "ply\nformat ascii 1.0\nelement a 1\nproperty int x\nproperty int x\nend_header\n", "ply\nformat ascii 1.0\nelement a 1\nproperty long x\nend_header\n", "ply\nformat ascii 1.0\nelement a\nend_header\n"])
def test_bad_headers(bad):
    with pytest.raises(ply.PlyError):
        ply.parse_header(bad.encode())


def test_missing_format_is_ascii():
    with pytest.warns(UserWarning):
        assert ply.parse_header(b"ply\nelement a 0\nproperty int x\nend_header\n").format == "ascii"


def test_texts(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 0 0 2\n0 1 0 3\n0 0 1 4\n0 0 0 1\n")
    m = texts.read_matrices(spark, str(tmp_path / "m.txt")).first()
    assert [m[n] for n in NAMES] == [1, 0, 0, 2, 0, 1, 0, 3, 0, 0, 1, 4]
    (tmp_path / "o.txt").write_text("scene model occ\n1 chef 70.5\n2 trex 85\n")
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "rs1_x").write_text("[d t]: Transformations for a/cheff_high.ply in s.ply:\n[d t]: Distance (trans, rot): 10.5, 0.1\n")
    joined = evaluation.joined(texts.read_occlusion(spark, str(tmp_path / "o.txt")), texts.read_logs(spark, str(logs)))
    rows = evaluation.flagged(joined, evaluation.diameters(spark)).orderBy("scene_num").collect()
    assert [(r["trans"], r["rot"], r["match"]) for r in rows] == [(10.5, 0.1, True), (None, None, False)]
    (tmp_path / "f.bin").write_bytes(struct.pack("<6f", 1, 2, 3, 4, 5, 6))
    assert [tuple(r)[2:] for r in texts.read_floats(spark, str(tmp_path / "f.bin"), 3).collect()] == [(1, 2, 3), (4, 5, 6)]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    """Ranges and split lines give the same numbers as reading from the beginning."""
    rows = [(k, k / 3.0, k % 7) for k in range(5000)]
    df = spark.createDataFrame(rows, "n long, d double, i int").repartition(7)
    for form in ply.FORMATS:
        path = str(tmp_path / f"{form}.ply")
        ply.write({"vertex": df}, path, form, doubles=True, order={"vertex": "n"})
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        try:
            back = ply.read(spark, path, range_bytes=9000)
            assert back.rdd.getNumPartitions() > 3
            assert sorted((r["row"], r["d"], r["i"]) for r in back.collect()) == rows
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        again = spark.read.format("ply").option("range_bytes", "9000").load(path) if form != "ascii" else back
        assert again.count() == 5000
    assert texts.lines(spark, str(tmp_path / "ascii.ply")).filter("line_no = 0").first()["line"] == "ply"


def test_lists_are_streamed(spark, tmp_path, monkeypatch):
    """Lists of changing length, elements before and after them, and files that end early."""
    faces = spark.createDataFrame([(k, list(range(k, k + (3 if k < 40 else 3 + k % 3))), k) for k in range(90)], "n long, vertex_indices array<int>, c int")
    points = spark.createDataFrame([(k, k / 4.0) for k in range(50)], "n long, x double")
    path = str(tmp_path / "m.ply")
    for form in ("binary_little_endian", "binary_big_endian", "ascii"):
        ply.write({"face": faces, "vertex": points}, path, form, order={"face": "n", "vertex": "n"})
        assert [tuple(r) for r in ply.read(spark, path, "face", range_bytes=100).orderBy("row").select("row", "vertex_indices", "c").collect()] == [tuple(r) for r in faces.orderBy("n").collect()]
        assert [(r["row"], r["x"]) for r in ply.read(spark, path, range_bytes=100).orderBy("row").collect()] == [(k, k / 4.0) for k in range(50)]
    ply.write({"face": faces}, path, "binary_little_endian", order={"face": "n"})
    whole = open(path, "rb").read()
    (tmp_path / "short.ply").write_bytes(whole[:-3])
    with pytest.raises(Exception, match="ends early"):
        ply.read(spark, str(tmp_path / "short.ply"), "face").count()
    (tmp_path / "wrapped.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nend_header\n1 2 3 4\n")
    assert [(r["x"], r["y"]) for r in ply.read(spark, str(tmp_path / "wrapped.ply")).collect()] == [(1, 2), (3, 4)]
    monkeypatch.setattr(ranges, "reachable", lambda path: False)  # a store that only Spark reads
    assert ply.read(spark, str(tmp_path / "wrapped.ply")).count() == 2


def test_values_are_carried_over_spans(spark):
    rows = [("f", k, str(k) if k in (3, 4, 57) else None) for k in range(100)] + [("g", 5, None)]
    df = spark.createDataFrame(rows, "file string, n long, v string")
    got = {(r["file"], r["n"]): r["last"] for r in fills.last_known(df, F.col("v"), "file", "n", "last", span=10).collect()}
    assert got == {(f, n): (None if f == "g" or n < 3 else "3" if n == 3 else "4" if n < 57 else "57") for f, n, _ in rows}


def test_empty_and_single_points(spark):
    shape = "cloud_id int, pt_id long, " + ", ".join(f"{c} double" for c in clouds.FIELDS)
    none = spark.createDataFrame([], shape)
    one = spark.createDataFrame([(0, 0, *[1.0] * 6)], shape)
    assert clouds.voxel_downsample(none, 0.1).count() == 0
    assert registration.register(one, one).count() == 0


def test_sampling_is_exact(spark):
    rows = spark.range(1000).select(F.lit(1).alias("cloud_id"), F.col("id").alias("pt_id"))
    assert clouds.random_sample(rows, 0.333, 1).count() == 333
    assert [r["pt_id"] for r in clouds.every_nth(rows, 300).orderBy("pt_id").collect()] == [0, 300, 600, 900]
    assert clouds.evenly_spaced(rows, 5).count() == 5


def test_command_line_prints_all_rows(spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_clouds", lambda spark, files: None)
    monkeypatch.setattr(cli, "register", lambda *a: spark.range(1500).withColumnRenamed("id", "answer"))
    cli.main(["--tau_d", "0.05", "--scene_files", "a.ply", "--model_files", "m.ply"])
    lines = capsys.readouterr().out.split()
    assert lines == ["answer", *map(str, range(1500))]


def test_command_line_wants_a_step_for_each_model():
    with pytest.raises(SystemExit):
        cli.main(["--tau_d", "0.05", "--scene_files", "a.ply", "--model_files", "m.ply,n.ply"])


def test_command_line_to_evaluation(spark, tmp_path, sf_dir, capsys):
    """Files are registered with steps of their own, validated, and the log is evaluated."""
    c = catalogue.cloud(spark, sf_dir)
    names = {0: "cheff_high", 1: "chicken_high"}
    for k, name in names.items():
        ply.write({"vertex": c.filter(f"cloud_id = {k}").select("pt_id", *clouds.FIELDS)}, str(tmp_path / f"{name}.ply"), "ascii", order={"vertex": "pt_id"})
    scene = clouds.transformed(c.filter("cloud_id <= 1"), rigid.literal(catalogue._T))
    ply.write({"vertex": scene.select("pt_id", *clouds.FIELDS)}, str(tmp_path / "rs1.ply"), "ascii", order={"vertex": "pt_id"})
    truth = tmp_path / "truth.txt"
    truth.write_text("\n".join(" ".join(map(str, r)) for r in [*catalogue._T, [0, 0, 0, 1]]))
    logs = tmp_path / "logs"
    logs.mkdir()
    files_ = [str(tmp_path / f"{n}.ply") for n in names.values()]
    cli.main(["--tau_d", "0.05,0.06", "--scene_files", str(tmp_path / "rs1.ply"), "--model_files", ",".join(files_), "--validation_files", f"{truth},{truth}", "--scene_leaf_size", "0.0001", "--logfile", str(logs / "rs1_run"), "--cpu_clustering", "true"])
    rows = [line.split("\t") for line in capsys.readouterr().out.splitlines()]
    assert sorted(r[1] for r in rows if r[0] == "rs1")[0] == "cheff_high" and len(rows) == 6
    (tmp_path / "o.txt").write_text("scene model occ\n1 chef 70.5\n1 chicken 60\n2 trex 85\n")
    found = files.evaluated(spark, str(tmp_path / "o.txt"), str(logs)).orderBy("occlusion").collect()
    assert [(r["model"], r["match"], r["rate"]) for r in found] == [("chicken", True, 1.0), ("chef", True, 1.0)]
    r = files.report(spark.createDataFrame(found)).first()
    assert r["n"] == 2 and r["match_rate"] == 1 and r["mean_norm_dist"] < 0.01


def test_report_without_a_running_rate(spark, sf_dir, monkeypatch):
    """A report sorts no rows: it has no rate up to each."""

    def sorted_(*_):
        raise AssertionError("a running rate")

    want = files.report(catalogue._evaluated(spark, sf_dir)).collect()
    monkeypatch.setattr(evaluation, "running_rate", sorted_)
    got = catalogue.QUERIES["evaluation_report"](spark, sf_dir).first()
    assert [round(x, 6) for x in want[0]] == list(got) and got["n"] > 0


def test_files_of_meshes(spark, tmp_path, capsys):
    source, to = tmp_path / "cube.ply", tmp_path / "out.ply"
    source.write_text(CUBE)
    files.main(["normals", str(source), str(to), "1", "2", "3"])
    rows = ply.read_cloud(spark, str(to)).orderBy("pt_id").collect()
    assert [(r["x"], r["y"], r["z"], r["nz"]) for r in rows] == [(1, 2, 3, 1), (2, 2, 3, 1), (2, 3, 3, 1), (1, 3, 3, 1)]
    assert (tmp_path / "out.ply.trans_adj").read_text() == "1.000000 2.000000 3.000000\n"
    files.main(["cloud", str(source), str(to), "2", "--centered"])
    rows = ply.read_cloud(spark, str(to)).orderBy("pt_id").collect()
    assert [(r["x"], r["y"], r["nz"]) for r in rows] == [(-0.5, -0.5, 1), (0.5, 0.5, 1)]
    files.main(["voxel", str(source), str(to), "--leaf", "2"])
    assert [tuple(r)[2:] for r in ply.read(spark, str(to)).collect()] == [(0.5, 0.5, 0.0)]
    assert capsys.readouterr().err.splitlines()[-2:] == ["points before filtering: 4 (x y z)", "points after filtering: 1 (x y z)"]


def test_typed_digests(spark, tmp_path):
    df = spark.range(1).selectExpr("transform(sequence(1, 10), x -> cast(x AS int)) AS a", "cast(null AS double) AS n", "named_struct('b', 'x', 'a', array(named_struct('q', 1L))) AS s", "named_struct('a', array(named_struct('q', 1L)), 'b', 'x') AS t", "cast(1 AS bigint) AS l", "cast(1 AS int) AS i")
    of = lambda c, **k: hashing.typed_digest(df, c, **k).first()["digest"]
    # Digests that the description of this scheme gives.
    assert of("a", form="base64") == "bKdecqzUpOrL4oxzk+cfyg" and of("n") == "7de5637fd217d0e44e0082f4d79b3e73"
    assert of("s") == of("t") and of("l") != of("i") and of("a", form="HEX") == of("a").upper()
    assert bytes(of("a", form="uint8")).hex() == of("a") and [int(x) for x in of("a", form="double")] == of("a", form="uint8")
    for method, n in (("SHA-1", 40), ("SHA-256", 64), ("SHA-384", 96), ("SHA-512", 128)):
        assert len(of("s", method=method)) == n
    (tmp_path / "f").write_bytes(b"abc")
    assert hashing.file_digests(spark, str(tmp_path / "f"), "SHA-512").first()["digest"] == hashlib.sha512(b"abc").hexdigest()
