import math
import random

from pyspark.sql import functions as F

from quillstone.functions import features, hashing, rigid
from quillstone.functions import vectors as V
from quillstone.functions.text import split_list


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_inverse_and_quaternion_round_trip(spark):
    r = random.Random(5)
    for _ in range(5):
        a, b, c = (F.lit(r.uniform(-3, 3)) for _ in range(3))
        m = rigid.multiply(rigid.rotx(a), rigid.multiply(rigid.roty(b), rigid.rotz(c)))
        back = rigid.from_quaternion(rigid.to_quaternion(m))
        t = m, V.literal(0.3, -2.0, 1.5)
        unit = rigid.compose(rigid.invert(t), t)
        row = _one(spark, gap=F.greatest(*[F.abs(x - y) for x, y in zip(m, back)]), det=rigid.determinant(m), off=F.greatest(*[F.abs(x) for x in unit[1]]), trace=unit[0][0] + unit[0][4] + unit[0][8])
        assert row["gap"] < 1e-6 and abs(row["det"] - 1) < 1e-9 and row["off"] < 1e-9 and abs(row["trace"] - 3) < 1e-9


def test_features_do_not_change_under_rigid_motion(spark):
    r = random.Random(2)
    p, n, q, m = (V.literal(*(r.gauss(0, 1) for _ in range(3))) for _ in range(4))
    turn = rigid.multiply(rigid.rotx(F.lit(0.7)), rigid.rotz(F.lit(-1.9)))
    t = turn, V.literal(4.0, 5.0, -6.0)
    before = features.pair_features(p, n, q, m)
    after = features.pair_features(rigid.apply(t, p), rigid.turn(turn, n), rigid.apply(t, q), rigid.turn(turn, m))
    assert _one(spark, gap=F.greatest(*[F.abs(a - b) for a, b in zip(before, after)]))["gap"] < 1e-9


def test_points_that_coincide_have_no_bins(spark):
    p, n = V.literal(1, 2, 3), V.literal(0, 0, 1)
    f = features.pair_features(p, n, p, n)
    row = _one(spark, **{f"k{k}": b for k, b in enumerate(features.bins(f, 0.1))})
    assert row["k1"] is None if row["k1"] is None else row["k2"] is None


def test_vote_codes(spark):
    code = V.pack_vote(F.lit(123456), F.lit(654321), F.lit(29))
    s, m, a = V.unpack_vote(code)
    row = _one(spark, s=s, m=m, a=a)
    assert (row["s"], row["m"], row["a"]) == (123456, 654321, 29)


def _fnv(values, signed):
    h = 2166136261
    for v in values:
        for b in v.to_bytes(4, "little"):
            h = ((h ^ (b | 0xFFFFFF00 if signed and b >= 128 else b)) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv(spark):
    values = [1, 200, 65535, 128]
    for signed in (False, True):
        assert _one(spark, h=hashing.fnv32([F.lit(v) for v in values], signed))["h"] == _fnv(values, signed)


def test_digest_forms(spark):
    row = _one(spark, a=hashing.digest(F.lit("abc")), b=hashing.digest(F.lit("abc"), "SHA-512", "base64"), c=hashing.digest(F.lit("abc"), "MD5", "uint8"))
    assert row["a"] == "900150983cd24fb0d6963f7d28e17f72" and not row["b"].endswith("=") and row["c"][:2] == [0x90, 0x01]


def test_alpha_bins_stay_in_range(spark):
    row = _one(spark, low=features.alpha_bin(F.lit(0.0), F.lit(math.pi)), high=features.alpha_bin(F.lit(math.pi), F.lit(0.0)), zero=features.alpha_bin(F.lit(1.0), F.lit(1.0)))
    assert row["high"] == 29 and 0 <= row["low"] <= 29 and row["zero"] == 15


def test_split_list():
    assert split_list(r'a,"b,c",,d\,e') == ["a", "b,c", "d,e"]


def test_md2_of_known_texts(spark):
    # The digests that the description of MD2 gives for these texts.
    known = {"": "8350e5a3e24c153df2275c9f80692773", "a": "32ec01ec4a6dac72c0ab96fb34c0b5d1", "abc": "da853b0d3f88d99b30283a69e6ded6bb", "message digest": "ab4f496bfb2a530b219ff33031fe06b0", "1234567890" * 8: "d5976f79d83d3a0dc9806c3c66f3efd8"}
    df = spark.createDataFrame([(k,) for k in [*known, None]], "t string")
    got = {r["t"]: r["h"] for r in df.select("t", hashing.digest(F.col("t"), "MD2").alias("h")).collect()}
    assert got == {**known, None: None}


def test_typed_columns_are_their_values_bytes(spark):
    """Buffers of whole columns against values one by one: nulls, empty and nested arrays, strings."""
    rows = [(1, [1.5, -2.0], [[1, 2], [], [3]], "né", (True, [1, None]), b"xy"), (None, [], None, "", (None, None), b""), (-7, None, [[], None, [9]], None, None, None), (3, [0.0], [], "z" * 9, (False, []), b"\0")]
    df = spark.createDataFrame(rows, "a bigint, b array<double>, c array<array<int>>, d string, e struct<q: boolean, p: array<int>>, f binary").coalesce(1)
    for part in (df, df.filter("a IS NULL OR a < 3")):
        for c in "abcdef":
            kind = df.schema[c].dataType
            values = part.toArrow().column(c).combine_chunks()
            assert hashing.typed_column(values, kind) == [hashing.typed_bytes(r[c], kind) for r in part.collect()]
            assert hashing.typed_column(values[1:], kind) == [hashing.typed_bytes(r[c], kind) for r in part.collect()][1:]
