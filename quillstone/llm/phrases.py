"""Operator 13: phrases of two to five words that occur together more often than their parts suggest.

A task gathers word ids of whole texts in shards, sorts each shard's suffixes by numpy prefix doubling, and reads
n-gram counts off the LCP intervals of the suffix array: suffixes that share their first k words lie side by side.
The shards' counts are merged by the phrase itself, so they are exact. A phrase is never more frequent than its
parts, so longer phrases are counted only where all their words, and then all their word pairs, are frequent: bitmaps
of bounded size (shared.Sieve) tell tasks which these are. A false hit of a bitmap costs a count, never a phrase.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sieve, documents, portions, small_join, spread, written

#: Occurrences from which a phrase counts, its most words, the phrases of a language that are returned, and the share
#: in percent of its occurrences that lie in one longer phrase which makes a phrase a part of that.
LEAST, LONGEST, MOST, SHARE = 100, 5, 2_000, 100
#: Words of a shard, about: what a task holds. Bytes of a text that are cut into words at once.
SHARD, SLICE = 1_000_000, 2_000_000

_UPPER, _BREAKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\v\f\r"
_AS_ONE = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + b"." * len(_BREAKS) + b" ")


def words_of(text: bytes):
    """Lists of words and, between pieces, b"."; long texts in several lists, cut between pieces where they can be."""
    text, a = text.translate(_AS_ONE), 0
    while a < len(text):
        b = len(text) if len(text) - a <= SLICE else text.find(b".", a + SLICE) + 1 or len(text)
        yield text[a:b].replace(b".", b" . ").split()  # of bytes: only spaces are left to cut at
        a = b


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ids in the order of the `depth` ids from there, or more, by prefix doubling."""
    rank, k = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth and len(ids):
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - k)] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        run = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(run[1:] != run[:-1])])
        k *= 2
    return order


def ngrams(ids: np.ndarray, lengths: range) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: a place of each different n-gram, and how often it occurs. Id 0 is in no n-gram."""
    depth = lengths[-1]
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    order = suffix_array(ids, depth)
    common, reach = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)  # words shared with the suffix before; words before the next 0
    same, runs = np.ones(max(0, len(ids) - 1), bool), np.ones(len(ids), bool)
    for k in range(depth):
        w = padded[order + k]
        runs &= w != 0
        reach += runs
        same &= (w[1:] == w[:-1]) & runs[1:]
        common[1:] += same
    out = {}
    for k in lengths:
        starts = np.flatnonzero(common < k)  # of the intervals of suffixes with k words in common
        counts = np.diff(np.append(starts, len(ids)))
        whole = reach[starts] >= k
        out[k] = order[starts[whole]], counts[whole]
    return out


def _key(lang: bytes, phrase: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\n" + phrase)


def _keys(lang: bytes, phrases: list[bytes]) -> np.ndarray:
    return np.fromiter((_key(lang, p) for p in phrases), np.uint64, len(phrases))


class _Shard:
    """Word ids of texts of one language."""

    def __init__(self):
        self.number = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b"."]  # 0
        self.parts: list[np.ndarray] = []

    def add(self, words: list[bytes], end: bool) -> None:
        n = len(words)
        ids = np.zeros(n + end, np.int32)
        ids[:n] = np.fromiter(map(self.number.__getitem__, words), np.int32, n)
        self.parts.append(ids)

    def count(self, lang: bytes, lengths: range, words: Sieve | None, pairs: Sieve | None):
        """(words, phrases, counts); of one word also the number of all words, as the phrase of none."""
        ids, names = np.concatenate(self.parts), list(self.number)
        if lengths[-1] == 1:
            n = np.bincount(ids, minlength=len(names))[1:]
            yield 0, pa.array([b""]), np.array([n.sum()])
            yield 1, pa.array(names[1:], pa.binary()), n
            return
        alive = words.has(_keys(lang, names))
        alive[0] = False
        ids = np.where(alive[ids], ids, 0)
        names = pa.array(names, pa.binary())

        def phrases(at: np.ndarray, k: int):
            return pc.binary_join_element_wise(*(names.take(pa.array(ids[at + j])) for j in range(k)), b" ")

        if lengths[0] > 2:  # only what lies in frequent pairs
            at, _ = ngrams(ids, range(2, 3))[2]
            codes = np.sort((ids[at].astype(np.int64) * len(names) + ids[at + 1])[pairs.has(_keys(lang, phrases(at, 2).to_pylist()))])
            both = np.isin(ids[:-1].astype(np.int64) * len(names) + ids[1:], codes) & (ids[:-1] > 0) & (ids[1:] > 0)
            left, right = np.append(both, False), np.append(False, both)  # the pair that begins, that ends with a word
            keep = left | right
            gap = keep & ~left  # the last word of a run: nothing follows it
            size = keep.astype(np.int64) + gap
            runs = np.zeros(int(size.sum()), np.int32)
            runs[(np.cumsum(size) - size)[keep]] = ids[keep]
            ids = runs
        else:  # one 0 is as good as several
            ids = ids[(ids != 0) | np.append(True, ids[:-1] != 0)]
        for k, (at, n) in ngrams(ids, lengths).items():
            yield k, phrases(at, k), n


def _counted(docs: DataFrame, lengths: range, words: Sieve | None = None, pairs: Sieve | None = None) -> DataFrame:
    """lang, words, phrase, f of the phrases of such lengths, their counts summed over all shards."""
    context = docs.sparkSession.sparkContext
    words, pairs = (x and context.broadcast(x) for x in (words, pairs))

    def run(batches):
        held, size = defaultdict(_Shard), 0

        def flush():
            for lang, shard in held.items():
                for k, phrases, n in shard.count(lang, lengths, words and words.value, pairs and pairs.value):
                    for a in range(0, len(phrases), 100_000):
                        p = phrases[a : a + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(p), pa.string()), pa.array([k] * len(p), pa.int32()), p.cast(pa.string()), pa.array(n[a : a + 100_000], pa.int64())], names=["lang", "words", "phrase", "f"])

        for b in portions(batches):
            for lang, text in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                for part in words_of(text):
                    held[lang].add(part, True)
                    size += len(part) + 1
                    if size >= SHARD:
                        yield from flush()
                        held, size = defaultdict(_Shard), 0
        yield from flush()

    src = spread(documents(docs, "lang", "text")).filter("text IS NOT NULL").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    out = src.mapInArrow(run, "lang string, words int, phrase string, f long")
    return out.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _sieve(phrases: DataFrame) -> Sieve:
    def run(batches):
        for b in batches:
            rows = zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.array([_key(*x) for x in rows], np.uint64).view(np.int64))})

    return Sieve.of(phrases.select("lang", "phrase").mapInArrow(run, "h long"), phrases.count())


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f of the phrases of up to `longest` words that occur `least` times; lang, n: all words)."""
    ones = written(_counted(docs, range(1, 2)).filter(f"words = 0 OR f >= {int(least)}"))
    found, totals = [ones.filter("words = 1")], ones.filter("words = 0").select("lang", F.col("f").alias("n"))
    words = _sieve(found[0])
    if longest > 1:
        found.append(written(_counted(docs, range(2, 3), words).filter(F.col("f") >= least)))
    if longest > 2:
        found.append(written(_counted(docs, range(3, longest + 1), words, _sieve(found[1])).filter(F.col("f") >= least)))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, totals


def scored(phrases: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases of two words or more, by their worst cut, without those that are
    parts of a longer one. phrases, totals: as frequent() gives them. Products are decimals of 38 digits."""
    candidates = phrases.filter("words > 1")
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = small_join(cuts, totals, ["lang"], "inner")
    wide = lambda c: f"cast({c} AS decimal(19, 0))"
    score = F.expr(f"cast(1000 * cast({wide('a')} * {wide('n')} AS decimal(34, 0)) AS decimal(38, 0)) div cast({wide('l')} * {wide('r')} AS decimal(38, 0))")
    worst = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("w")
    best = cuts.groupBy("lang", "phrase").agg(worst, F.first("a").alias("a"), F.first("n").alias("n"))
    inner = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
    longer = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(F.expr(inner))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    out = best.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {int(share)} * a"))
    return out.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, share: int = SHARE) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the `most` best phrases of each language, by score, then a
    (both falling), then phrase in the order of its bytes.

    Texts are lower-cased (A to Z), cut into pieces at marks and line ends and those into words at spaces and tabs.
    A null lang is the language `und`; null and empty texts have no words; rows that come twice count twice; a
    language without a candidate has no row, nor has an empty table. Other columns are ignored. Ranks come from
    a sort by ranges whose parts are numbered on their own: no language is one task's.
    """
    order = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = scored(*frequent(docs, least, longest), share).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = written(rows.select("*", at.alias("at")).withColumn("part", F.shiftright("at", 33)))
    sizes = rows.groupBy("lang", "part").agg(F.min("at").alias("from"), F.count("*").alias("size"))
    before = sizes.select("lang", F.col("part").alias("other"), F.col("size").alias("n_before"))
    # the parts of one sort hold runs of languages, so few parts have rows of one
    starts = small_join(sizes, before.groupBy("lang").agg(F.collect_list(F.struct("other", "n_before")).alias("all")), ["lang"], "inner")
    ahead = F.expr("aggregate(filter(all, x -> x.other < part), 0L, (s, x) -> s + x.n_before)")
    starts = starts.select("lang", "part", (ahead - F.col("from") + 1).alias("shift"))
    out = small_join(rows, starts, ["lang", "part"], "inner").withColumn("rank", F.col("at") + F.col("shift"))
    return out.filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
sized AS (SELECT lang, w, unnest(range(1, {LONGEST + 1})) AS k FROM worded WHERE len(w) > 0),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k AS words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.a, x.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM c) x JOIN c USING (lang, phrase) JOIN totals t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : x.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[x.k + 1 :], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, a, w, unnest(range(2, words)) AS m FROM c)) GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SHARE} * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= {MOST}
"""
