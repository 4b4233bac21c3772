"""Operator 2: language identification by words first, then by shorter and shorter character n-grams.

The model is learned from a bounded sample of labelled documents (MAX_DOCS, spread over the languages by
a hash of the row, whatever the size of the corpus). A word that the sample knows has a log frequency in
each language; an unseen word is scored by the longest order of n-grams, from ORDER down to 1, at which
all its n-grams are known in some language.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, documents, letter_words, spread

#: Documents that the model is learned from, in expectation, shared equally by the languages.
MAX_DOCS = 8_000
#: A word is known from so many occurrences in the sample.
LEAST_COUNT = 3
#: Longest n-grams.
ORDER = 5
#: Words beyond which more evidence doesn't raise the score.
SURE_WORDS = 24

#: Words whose scores a worker keeps.
CACHED = 300_000

def grams(word: str, n: int) -> list[str]:
    w = f"_{word}_"
    return [w[k : k + n] for k in range(len(w) - n + 1)] or [w]


class Model:
    """Log frequencies by language of words and n-grams; `score` gives a vector over langs for a word."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        n = len(self.langs)
        both: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        tables: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(n)) for _ in range(ORDER)]
        for k, lang in enumerate(self.langs):
            for w, c in counts[lang].items():
                if w:
                    both[w][k] += c
                    for order in range(1, ORDER + 1):
                        for g in grams(w, order):
                            tables[order - 1][g][k] += c
        total = sum(both.values(), np.zeros(n)) + 1
        self.words = {w: np.log((c + 0.1) / total) for w, c in both.items() if c.sum() >= LEAST_COUNT}
        self.grams = []  # by order: the row of each n-gram, and the rows' log frequencies
        for t in tables:
            found = np.array([*t.values()], float).reshape(len(t), n)
            self.grams.append(({g: k for k, g in enumerate(t)}, np.log((found + 0.1) / (found.sum(axis=0) + 1))))
        self.rows, self.scores = {}, np.empty((0, n))  # of the words met so far

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each word, relative to the best language, so that words of different orders weigh alike."""
        out = np.zeros((len(words), len(self.langs)))
        left = []
        for k, w in enumerate(words):
            known = self.words.get(w)
            if known is None:
                left.append(k)
            else:
                out[k] = known
        for order in range(ORDER, 0, -1):
            now = [k for k in left if len(words[k]) + 2 >= order]
            if not now:
                continue
            place, table = self.grams[order - 1]
            parts = [grams(words[k], order) for k in now]
            at = np.fromiter((place.get(g, -1) for p in parts for g in p), np.int64)
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            starts = np.cumsum(n) - n
            whole = np.minimum.reduceat(at, starts) >= 0  # all its n-grams are known
            if whole.any():
                means = np.add.reduceat(table[at], starts) / n[:, None]
                k = np.array(now)
                out[k[whole]] = means[whole]
                done = set(k[whole].tolist())
                left = [x for x in left if x not in done]
        return out - out.max(axis=1, keepdims=True) if self.langs else out

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(letter_words(text))
        if not found or not self.langs:
            return "und", 0.0
        rows = self.rows
        new = [w for w in found if w not in rows]
        if len(rows) + len(new) > CACHED:
            rows.clear()
            new = list(found)
        if new:
            end = len(rows) + len(new)
            if end > len(self.scores):
                self.scores = np.concatenate([self.scores[: len(rows)], np.empty((end + 4096, len(self.langs)))])
            self.scores[len(rows) : end] = self.score(new)
            rows.update(zip(new, range(len(rows), end)))
        at = np.fromiter(map(rows.__getitem__, found), np.int64, len(found))
        total = np.fromiter(found.values(), np.float64, len(found)) @ self.scores[at]
        n = sum(found.values())
        p = np.exp((total - total.max()) * min(1.0, SURE_WORDS / n))
        k = int(total.argmax())
        return self.langs[k], float(p[k] / p.sum())


def held_out(doc_id: Column) -> Column:
    """Null ids aren't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """From text and non-null lang of documents that aren't held out. A task counts its words; what comes
    to the driver is bounded by the sample. Rows are drawn by doc_id and text, so that rows which share a doc_id, or
    have none, don't come all together (see bounded() for equal ones)."""
    src = documents(docs, "doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in src.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    share = max_docs / len(sizes)
    spark = docs.sparkSession
    parts = spark.createDataFrame([(k, min(1.0, share / n)) for k, n in sizes.items()], "lang string, part double")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = bounded(spread(src).join(F.broadcast(parts), "lang").filter(drawn < F.col("part")).select("lang", "text"), max_docs)

    def count(batches):
        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[lang].update(letter_words(text))
        for lang, c in found.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    rows = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for b in rows.toArrow().to_batches():
        for lang, w, n in zip(*(b.column(k).to_pylist() for k in range(3))):
            counts[lang][w] = n
    return Model(counts)


_held: dict[str, Model] = {}  # of this worker


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. No letter, null text or no model: und, 0.

    Equal rows give equal rows; ties go to the first language in order; other columns are ignored.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        if name not in _held:
            _held.clear()
            _held[name] = sent.value
        for b in batches:
            found = [_held[name].predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "held_out": b.column("held_out"),
                    "lang_pred": pa.array([x[0] for x in found], pa.string()),
                    "score": pa.array([x[1] for x in found], pa.float64()),
                }
            )

    return spread(documents(docs)).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    return predict(docs, learn(docs, max_docs))
