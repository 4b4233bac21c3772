"""Operator 5: quality rules with robust multivariate outliers by language and source.

Each text gives counts, and these a transformed vector. For each (lang, source) the centre and covariance
of its vectors come from minimum-covariance-determinant concentration steps over all rows: from medians
and deviations, the COVERED share of rows nearest by Mahalanobis distance gives the next estimate, which a group
takes if its determinant falls by it. As no determinant ever rises and FLOOR bounds them, the steps come to an end:
after the first in which none falls by more than STILL. The steps are aggregations with partial sums in each task, so a hot group isn't
gathered anywhere. A group's estimate is shrunk towards its language's, and that towards the table's, with
the weight of PRIOR rows: there is no size from which a group counts. Documents that lie beyond CUTOFF, by
what is above their group's centre, are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, dropped, small_join, spread, written

#: Share of a group's rows that an estimate covers.
COVERED = 0.75
#: Change of a log determinant from which steps go on.
STILL = 0.01
#: Squared distance beyond which a document is rejected.
CUTOFF = 25.0
#: Median of the chi-squared distribution with as many degrees of freedom as FIELDS has: scales the distances.
MEDIAN = 5.348
FIELDS = ["x_length", "x_symbols", "x_upper", "x_marks", "x_repeats", "x_lines"]
#: Rows that a language's estimate stands for beside a group's own, and the table's beside a language's: two
#: for each dimension.
PRIOR = 2 * len(FIELDS)
#: Standard deviations that are added in quadrature, in the units of FIELDS: a field that never varies
#: doesn't make the least change of it an outlier.
FLOOR = np.array([0.1, 0.05, 0.05, 0.05, 0.15, 0.15])

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?@^~={}[]\\/_`"


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    kinds, x = len(number), w[:n]
    for k in range(1, width):
        if int(x.max()) >= (1 << 62) // max(kinds, 1):  # renumbered before the products leave 64 bits
            x = np.unique(x, return_inverse=True)[1]
        x = x * kinds + w[k : k + n]
    _, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper-case letters, marks."""
    b = (text or "").encode()
    words = b.split()  # of bytes: at \x20 and \x09-\x0D
    chars = len(text or "") - (len(b) - len(b.translate(None, _SPACE)))
    lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
    upper = sum(map(str.isupper, text)) if text and not text.isascii() else len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, len(b) - len(b.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), upper, len(b) - len(b.translate(None, _MARKS)), len(lines)


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, the counts of measure(), base_failed and the vector FIELDS."""

    def run(batches):
        for b in batches:
            found = [measure(t) for t in b.column("__text").to_pylist()]
            cols = [pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64()) for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *_NAMES])

    shape = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in _NAMES)])
    out = spread(docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))).mapInArrow(run, shape)
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    vector = {
        "x_length": F.log(chars / n),
        "x_symbols": F.sqrt(F.col("n_symbols") / chars),
        "x_upper": F.sqrt(F.col("n_upper") / chars),
        "x_marks": F.sqrt(F.col("n_marks") / chars),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
        "x_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
    }
    return out.withColumn("base_failed", failed).withColumns(vector)


def _terms() -> list[Column]:
    """What each field adds to the squared Mahalanobis distance."""
    d = [F.col(x) - F.col("centre")[k] for k, x in enumerate(FIELDS)]
    p = len(FIELDS)
    return [sum((d[j] * F.col("precision")[i * p + j] for j in range(p)), F.lit(0.0)) * d[i] for i in range(p)]


def _distance() -> Column:
    return sum(_terms(), F.lit(0.0))


_SUMS = [f"s{k}" for k in range(len(FIELDS))]
_PRODUCTS = [f"q{i}{j}" for i in range(len(FIELDS)) for j in range(i, len(FIELDS))]


def combined(n: float, centre: np.ndarray, covariance: np.ndarray, prior: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(centre, covariance) of n rows, those of the prior counting as PRIOR more rows."""
    w = n / (n + PRIOR)
    return w * centre + (1 - w) * prior[0], w * covariance + (1 - w) * prior[1]


def _solve(moments: DataFrame) -> DataFrame:
    """grp, centre, precision, log_det of moments: lang, grp, n, sums, products (about the group's centre). The
    covariance of a language and of the table is that within their groups; there is a row for each group, and no more."""
    p, cols = len(FIELDS), ["n", *_SUMS, *_PRODUCTS]
    total = lambda df: df.agg(*[F.sum(c).alias("t_" + c) for c in cols])
    langs = moments.groupBy("lang").agg(*[F.sum(c).alias("l_" + c) for c in cols])
    rows = small_join(moments, langs, ["lang"], "inner").crossJoin(F.broadcast(total(moments)))  # one row
    kind = pa.list_(pa.float64())

    def moment(x: np.ndarray) -> tuple:
        q = np.zeros((p, p))
        q[np.triu_indices(p)] = x[1 + p :] / x[0]
        return x[0], x[1 : 1 + p] / x[0], q + q.T - np.diag(np.diag(q))

    def run(batches):
        for b in batches:
            x = {t: np.stack([b.column(t + c).to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1) for t in ("", "l_", "t_")}
            centre, precision, det = [], [], []
            for k in range(b.num_rows):
                m, c = combined(*moment(x[""][k]), combined(*moment(x["l_"][k]), moment(x["t_"][k])[1:]))
                c = c + np.diag(FLOOR**2)
                centre.append(m.tolist())
                precision.append(np.linalg.inv(c).ravel().tolist())
                det.append(float(np.linalg.slogdet(c)[1]))
            yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(centre, kind), pa.array(precision, kind), pa.array(det, pa.float64())], names=["grp", "centre", "precision", "log_det"])

    return rows.mapInArrow(run, "grp string, centre array<double>, precision array<double>, log_det double")


def estimates(rows: DataFrame) -> DataFrame:
    """grp, centre, precision, scale by minimum covariance determinant; rows: lang, grp (with the lang in it) and FIELDS."""
    p = len(FIELDS)
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5).alias(f"m{k}") for k, x in enumerate(FIELDS)])
    middle = written(middle.select("grp", F.array(*[f"m{k}" for k in range(p)]).alias("centre")))
    near = small_join(rows, middle, ["grp"], "inner")
    spreads = near.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col("centre")[k]), 0.5).alias(f"d{k}") for k, x in enumerate(FIELDS)])
    weights = [F.lit(0.0) if i != j else 1 / (F.pow(1.4826 * F.col(f"d{i}"), 2) + float(FLOOR[i] ** 2)) for i in range(p) for j in range(p)]
    now = written(middle.join(spreads, "grp").select("grp", "centre", F.array(*weights).alias("precision"), F.lit(float("inf")).alias("log_det")))
    made = [middle, now]
    while True:
        far = small_join(rows, now, ["grp"], "inner").withColumn("d", _distance())
        edge = written(far.groupBy("grp").agg(F.percentile_approx("d", COVERED).alias("edge")))
        kept = small_join(far, edge, ["grp"], "inner").filter("d <= edge")
        products = [F.sum(F.col(FIELDS[int(q[1])]) * F.col(FIELDS[int(q[2])])).alias(q) for q in _PRODUCTS]
        found = kept.groupBy("lang", "grp").agg(F.count("*").alias("n"), *[F.sum(x).alias(c) for x, c in zip(FIELDS, _SUMS)], *products)
        found = found.withColumns({q: F.col(q) - F.col(_SUMS[int(q[1])]) * F.col(_SUMS[int(q[2])]) / F.col("n") for q in _PRODUCTS})
        moments = written(found)
        # estimates hang together by their priors, so a group's determinant could rise as another's falls, and so on forever
        step = _solve(moments).select("grp", F.struct("centre", "precision", "log_det").alias("new"))
        step = small_join(now, step, ["grp"], "left").withColumn("fell", F.col("log_det") - F.col("new.log_det"))
        best = [F.when(F.col("fell") > 0, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "precision", "log_det")]
        now = written(step.select("grp", *best, "fell"))
        made += [edge, moments, now]
        if now.filter(F.col("fell") > STILL).isEmpty():
            break
    scale = small_join(rows, now, ["grp"], "inner").withColumn("d", _distance()).groupBy("grp").agg(F.count("*").alias("n"), F.greatest(F.percentile_approx("d", 0.5) / MEDIAN, F.lit(1.0)).alias("own"))
    # a median of few rows is shrunk like the estimates, towards what the scale of normal vectors is
    scale = scale.select("grp", ((F.col("n") * F.col("own") + PRIOR) / (F.col("n") + PRIOR)).alias("scale"))
    out = written(now.join(scale, "grp").select("grp", "centre", "precision", "scale"))
    for x in made:
        dropped(x)
    return out


def judge(docs: DataFrame, keep: list[str] | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """The columns `keep` of docs (doc_id), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance.

    Null texts have no words and fail. Null languages and sources are groups like others. A group's estimate
    comes from its rows that don't fail by the base rules, and from its language's and the table's (see
    combined()). Every row is judged on its own; other columns of docs, whatever their names, aren't read.
    """
    keep = keep or ["doc_id"]
    src = documents(docs, *dict.fromkeys([*keep, "lang", "source", "text"]))
    named = {c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source")}
    src = src.withColumns({"__lang": named["lang"], "__grp": F.concat(named["lang"], F.lit("\t"), named["source"])})
    rows = written(statistics(src, [*keep, "__lang", "__grp"]).withColumnsRenamed({"__lang": "__l", "__grp": "grp"}))
    models = estimates(rows.filter("NOT base_failed").select(F.col("__l").alias("lang"), "grp", *FIELDS))
    far = small_join(rows, models, ["grp"], "left").withColumn("distance", _distance() / F.col("scale"))
    # more than usual of symbols, capitals, marks or repeats, or longer words than usual, is bad; less isn't
    above = sum((F.when(F.col(x) > F.col("centre")[k], t).otherwise(0.0) for (k, x), t in zip(enumerate(FIELDS), _terms())), F.lit(0.0)) / F.col("scale")
    out = F.coalesce((F.col("distance") > cutoff) & (above > cutoff), F.lit(False))
    return far.select(*keep, *_NAMES[:5], "base_failed", (~F.col("base_failed") & ~out).alias("kept"), "distance")


#: DuckDB's form of what the base rules give, over the view documents.
ORACLE_BASE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, k, list_slice(w, k, k + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS k FROM d)
), again AS (
  SELECT doc_id, k FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), inside AS (
  SELECT doc_id, count(DISTINCT k + j) AS n FROM again, (SELECT unnest(range(0, 5)) AS j) GROUP BY ALL
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL
), base AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(inside.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN inside USING (doc_id)
)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
FROM base
"""
