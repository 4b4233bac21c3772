"""Operator 4: quality by ordinal cumulative-link regression on graded ratings.

Texts become hashed features: distinct words, beginnings of long words, and binned statistics of the whole
text. One weight for each feature is shared by all grades; ordered thresholds cut the sum of weights into
grades: P(grade <= k) is the logistic function of threshold k minus the sum. Selection goes by the
probability of a grade of `good` or more. Fitted on a bounded sample of rated documents (MAX_RATED);
features that don't differ between grades beyond chance have no weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, documents, dropped, letter_words, spread, written

#: Rated documents, in expectation, that the model is fitted on.
MAX_RATED = 16_000
#: Documents of the sample that a feature is in, at least, and how far its grades' mean must lie from all
#: documents' mean, in standard errors and in grades.
LEAST_DOCS, LEAST_Z, LEAST_SHIFT = 4, 4.5, 0.4
#: Grades made of the table labels: harmful, poor, good.
HARMFUL, POOR, GOOD = 0, 1, 2
#: Probability of a good grade from which a document is selected.
SELECT = 0.5

_symbols = b"#*$%&|<>!?@^~={}[]\\/_`"


def _hash(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature) - (1 << 63)


def word_features(word: str) -> list[int]:
    return [_hash("w" + word)] + [_hash(f"p{n}{word[:n]}") for n in (4, 5, 6) if len(word) > n]


def text_features(text: str, words: list[str]) -> list[int]:
    """Of binned shares: symbols, capitals, distinct words, words equal to the one before, the length."""
    b, n = text.encode(), max(1, len(words))
    size = max(1, len(b))
    caps = len(b) - len(b.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    again = sum(map(str.__eq__, words, words[1:]))
    shares = {"sym": (size - len(b.translate(None, _symbols))) / size, "cap": caps / size, "uniq": len(set(words)) / n ** 0.9, "again": again / n}
    return [_hash(f"s{k}{int(np.sqrt(max(0.0, v)) * 12)}") for k, v in shares.items()] + [_hash(f"slen{int(np.log2(n))}")]


class Model:
    """weights by feature hash, ascending thresholds between grades."""

    def __init__(self, weights: dict[int, float], cuts: np.ndarray):
        self.weights, self.cuts, self.cache = weights, cuts, {}

    def score(self, text: str, words: list[str] | None = None) -> float:
        """words: those of text, if they are known already."""
        words = letter_words(text) if words is None else words
        get, cache, total = self.weights.get, self.cache, 0.0
        for w in set(words):
            v = cache.get(w)
            if v is None:
                if len(cache) > 250_000:
                    cache.clear()
                v = cache[w] = sum(get(f, 0.0) for f in word_features(w))
            total += v
        return total + sum(get(f, 0.0) for f in text_features(text, words))

    def grades(self, score: float) -> np.ndarray:
        """The probability of each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.cuts - score, -40, 40)))
        return np.diff(np.concatenate([[0.0], below, [1.0]]))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, n_grades: int, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) that maximise the likelihood less ridge / 2 times the squared weights."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], np.int64)
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 0.5)[:-1] / (len(grades) + 0.5 * n_grades)
    cuts = np.log(share / (1 - share))
    w = np.zeros(n_features)
    low, gaps = cuts[:1].copy(), np.log(np.maximum(np.diff(cuts), 0.05))
    past = [np.full(x.shape, 1e-6) for x in (w, low, gaps)]
    for _ in range(steps):
        cuts = np.concatenate([low, low + np.cumsum(np.exp(gaps))])
        s = np.bincount(doc, w[feature], len(rows))
        logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, down = logistic(edges[grades + 1] - s), logistic(edges[grades] - s)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        g_s = d_up - d_down  # of the negative log likelihood by the score
        g_w = np.bincount(feature, g_s[doc], n_features) + ridge * w
        g_cuts = np.bincount(np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -d_up, 0), n_grades - 1)
        g_cuts += np.bincount(np.maximum(grades - 1, 0), np.where(grades > 0, d_down, 0), n_grades - 1)
        g_gaps = np.cumsum(g_cuts[::-1])[::-1][1:] * np.exp(gaps)
        for x, g, h in zip((w, low, gaps), (g_w, g_cuts.sum(keepdims=True), g_gaps), past):
            h += g * g
            x -= 0.5 * g / np.sqrt(h)
    return w, np.concatenate([low, low + np.cumsum(np.exp(gaps))])


def rated(docs: DataFrame, labels: DataFrame, grade: Column, max_rated: int = MAX_RATED) -> DataFrame:
    """text, grade of a sample of about max_rated rows of docs that labels rate. The side that is broadcast has
    about that many rows too, whatever its table holds. Rows are drawn by doc_id and text (see bounded() for equal ones)."""
    marked = labels.select("doc_id", grade.cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")
    share = lambda n: int(min(1.0, max_rated / max(1, n)) * (1 << 30))
    marked = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share(marked.count()))
    marked = F.broadcast(marked.groupBy("doc_id").agg(F.min("grade").alias("grade")))
    held = documents(docs).filter("text IS NOT NULL")
    part = share(held.select("doc_id").join(marked, "doc_id").count())
    out = held.join(marked, "doc_id").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < part)
    return bounded(out.select("text", "grade"), max_rated)


def label_grade() -> Column:
    """Of the columns of the table labels: toxic documents are harmful, others go by their quality."""
    return F.when(F.col("toxic") == 1, HARMFUL).when(F.col("quality") == 0, POOR).when(F.col("quality") == 1, GOOD)


def fit(sample: DataFrame, n_grades: int = 3) -> Model:
    """sample: text, grade (0 to n_grades - 1), bounded (see rated()). An empty one gives a model without
    weights. Tasks count features by grade; what comes to the driver are the features that differ by grade,
    and the sample's rows of these."""

    def all_features(t: str) -> set[int]:
        words = letter_words(t)
        return set(text_features(t, words)).union(*map(word_features, set(words)))

    def count(batches):
        for b in batches:
            n, total = {}, {}
            for g, t in zip(b.column("grade").to_pylist(), b.column("text").to_pylist()):
                for f in all_features(t):
                    n[f] = n.get(f, 0) + 1
                    total[f] = total.get(f, 0) + g
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["f", "n", "total"])

    sample = written(sample.select("text", "grade"))
    overall = sample.agg(F.avg("grade"), F.stddev_pop("grade")).first()
    if overall[0] is None:
        dropped(sample)
        return Model({}, np.zeros(n_grades - 1))
    mean, spread_ = overall[0], max(overall[1], 1e-9)
    counts = sample.mapInArrow(count, "f long, n long, total long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    shift = F.abs(F.col("total") / F.col("n") - mean)
    used = counts.filter((F.col("n") >= LEAST_DOCS) & (shift >= LEAST_SHIFT) & (shift * F.sqrt("n") / spread_ >= LEAST_Z))
    names = sorted(r["f"] for r in used.select("f").collect())
    place = sample.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def rows_of(batches):
        for b in batches:
            out = [sorted(place.value[f] for f in all_features(t) if f in place.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"grade": b.column("grade"), "features": pa.array(out, pa.list_(pa.int32()))})

    table = sample.mapInArrow(rows_of, "grade int, features array<int>").toArrow()
    rows = sorted(zip(table.column("grade").to_pylist(), table.column("features").to_pylist()))  # sums must not depend on the order
    dropped(sample)
    w, cuts = fit_ordinal([r for _, r in rows], np.array([g for g, _ in rows]), len(names), n_grades)
    return Model(dict(zip(names, w.tolist())), cuts)


def _graded(docs: DataFrame, model: Model, good: int, finish, schema, columns: list[str]) -> DataFrame:
    """finish(batch, expected grades, probabilities of good or more) -> batch."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            expected, tail = [], []
            for t in b.column("text").to_pylist():
                words = letter_words(t)
                if not words:
                    expected.append(0.0)
                    tail.append(0.0)
                    continue
                p = sent.value.grades(sent.value.score(t, words))
                expected.append(float(p @ np.arange(len(p))))
                tail.append(float(p[good:].sum()))
            yield finish(b, expected, tail)

    return spread(docs.select(*[F.col(f"`{c}`") for c in columns])).mapInArrow(run, schema)


def grade(docs: DataFrame, model: Model, good: int = GOOD, select: float = SELECT) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of a grade of `good` or more), kept (that is `select` or more).

    Null texts and those without a letter have the lowest grade. Equal rows give equal rows; other columns
    are ignored.
    """

    def finish(b, expected, tail):
        return pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "expected_grade": pa.array(expected, pa.float64()), "tail_probability": pa.array(tail, pa.float64()), "kept": pa.array([p >= select for p in tail], pa.bool_())})

    return _graded(docs, model, good, finish, "doc_id long, expected_grade double, tail_probability double, kept boolean", ["doc_id", "text"])


def select(docs: DataFrame, model: Model, good: int = GOOD, select: float = SELECT) -> DataFrame:
    """docs, with all its columns, without the rows that grade() doesn't keep."""

    def finish(b, expected, tail):
        return b.filter(pa.array([p >= select for p in tail], pa.bool_()))

    return _graded(docs, model, good, finish, docs.schema, docs.columns)
