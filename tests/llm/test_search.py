"""Operators 11 to 13 against brute force and SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import codes, phrases, queries, simhash


def same_as_sql(spark, sf_dir, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, sf_dir).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


# ---- 11

def brute_codes(rows, entries=256, rounds=4):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v], label))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    kept = [(i, v + [0] * (4 * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v, _ in first] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width]
                groups[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out, totals = [], Counter()
    for i, v, label in kept:
        found = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(4)]
        error = min(sum(d for d, _ in found), (1 << 63) - 1)
        totals[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(totals[label], (1 << 63) - 1), sha) for i, c, e, label in out), key=str)


ODD = [(1, [0.5, -0.25, 1.0, 2.0, -3.0, 0.125], 1, "h"), (0, [0.5] * 6, None, "h"), (0, [0.25] * 6, None, "h"), (3, None, 1, "h"), (4, [1.0, None], 1, "h"), (5, [1.0, math.nan], 1, "h"), (6, [math.inf] * 6, 1, "h"), (7, [], 2, "h"), (None, [9.0] * 5, 2, "h"), (8, [0.5] * 6, None, "h"), (8, [0.5] * 6, None, "h"), (9, [-1e-9] * 6, 1, "h"), (2, [1.5, 2.5], 3, "h")]


@pytest.mark.parametrize("entries, scale", [(256, 1), (3, 1), (3, 70_000.0), (4, 3e6)])
def test_codes_of_odd_rows(spark, entries, scale):
    """The larger scales need integers of 64 bits, and those of any size."""
    rows = [(i, v and [x if x is None else x * scale for x in v], label, code) for i, v, label, code in ODD]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")
    got = sorted(map(tuple, codes.compress(df, entries).collect()), key=str)
    assert got == brute_codes([r[:3] for r in rows], entries)
    assert codes.compress(df.limit(0)).count() == 0


def test_codes_are_the_sql_ones(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op11_codes", "embeddings")


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(0, 30), st.integers(1, 3), st.integers(1, 50), st.sampled_from([np.float64, np.int64, object]), st.integers(0, 10_000))
def test_exponion_finds_the_nearest(k, n, width, top, kind, seed):
    r = np.random.default_rng(seed)
    entries, x = r.integers(-top, top + 1, (k, width)), r.integers(-top, top + 1, (n, width))
    index, error = codes.Book(entries.astype(kind)).nearest(x.astype(kind), r.integers(0, k, n))
    d = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == d.argmin(axis=1).tolist() and [int(e) for e in error] == d.min(axis=1).tolist()


def test_exponion_scans_less():
    r = np.random.default_rng(1)
    entries, x = r.integers(-300, 300, (256, 4)).astype(float), r.integers(-300, 300, (4000, 4)).astype(float)
    book = codes.Book(entries)
    start, _ = book.nearest(x, np.zeros(4000, np.int64))
    book.scanned = 0
    again, _ = book.nearest(x, start)
    assert (again == start).all() and book.scanned < 0.5 * 256 * 4000


# ---- 12

def brute_copies(rows, linked=3):
    fps = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        c = np.zeros(64, int)
        for s in shingles:
            h = xxhash.xxh64(s.encode(), seed=42).intdigest()
            c += [h >> b & 1 for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if 2 * c[b] > len(shingles)))
    return [(i, f"{fp:016x}", least) for (i, _), fp, least in zip(rows, fps, brute_components(fps, [i for i, _ in rows], linked))]


def brute_components(fps, ids, linked=3):
    f, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[k + 1 :] ^ f[k]) <= linked) + k + 1:
            a, b = sorted((find(k), find(int(j))))
            root[b] = a
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(f))]


def test_copies(spark, sf_dir, docs, empty):
    for src in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in src.select("doc_id", "text").collect()]
        assert sorted(map(tuple, simhash.near_copies(src).collect()), key=str) == sorted(brute_copies(rows), key=str)
    assert simhash.near_copies(empty).count() == 0


@pytest.mark.parametrize("parts, block, stream", [((2,), 4096, 65536), ((3,), 2, 3), ((4,), 5, 2), ((2, 3, 4), 1, 1)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, parts, block, stream):
    """Chains of near fingerprints, common values, all layouts, blocks and streams of a few."""
    r = np.random.default_rng(7)
    fps = {0, 1, 3, 2**63, 2**64 - 1}
    for centre in r.integers(0, 1 << 63, 6, dtype=np.uint64).tolist():
        x = centre
        for _ in range(60):  # a walk: links reach far from where it began
            x ^= sum(1 << int(b) for b in r.choice(64, int(r.integers(1, 6)), replace=False))
            fps.add(x)
    fps |= {(0xABCD << 48) | int(x) for x in r.integers(0, 1 << 48, 80)}  # one value of sixteen bits
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "PARTS", parts)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "STREAM", stream)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long").repartition(3)
    near = simhash.components(simhash.links(df)).collect()
    got = {x: x for x in fps}
    for c in near:
        got[c["node"] % (1 << 64)] = c["class"] % (1 << 64)
    want = brute_components(fps, list(range(len(fps))))
    kinds = {}
    assert all(kinds.setdefault(w, got[x]) == got[x] for x, w in zip(fps, want)) and len(set(kinds.values())) == len(kinds)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 4), st.integers(0, 5), st.integers(0, 1000))
def test_thresholds_cost_least(m, linked, seed):
    r = np.random.default_rng(seed)
    parts = np.array_split(r.permutation(64), m)
    plan = simhash.Layout([p.tolist() for p in parts], [np.cumsum(r.random((linked + 1, 1 << 16)) * 9, axis=0) for _ in parts], linked)
    fp = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    got, cost = plan.thresholds(fp)
    assert (got.sum(axis=0) == linked - m + 1).all()
    for k, x in enumerate(fp):
        own = [plan.costs[p][:, simhash.values(np.array([x]), plan.parts[p])[0] & 0xFFFF] for p in range(m)]
        value = lambda t: sum(own[p][x] if x >= 0 else 0 for p, x in enumerate(t))
        every = [t for t in np.ndindex(*[linked + 2] * m) if sum(t) - m == linked - m + 1]
        assert cost[k] == pytest.approx(min(value([x - 1 for x in t]) for t in every)) == pytest.approx(value(got[:, k].tolist()))


# ---- 13

def brute_phrases(rows, least, most, share=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for a in range(len(w) - k + 1):
                    f[lang][tuple(w[a : a + k])] += 1
    out = []
    for lang, own in f.items():
        found = []
        good = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        inside = defaultdict(int)
        for p, a in good.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inside[p[k : k + m]] = max(inside[p[k : k + m]], a)
        for p, a in good.items():
            score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < share * a:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_phrases_of_odd_rows(spark, docs, empty, monkeypatch):
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    more = [("en", "A b\tc  d e! a B c d e\x0ba b c\x0cx\x00y a b"), (None, "x " * 50 + ". " + "x y " * 9), ("und", "x y z"), ("en", "é É é É, é É"), ("en", "-" * 500)] * 3
    src = docs.select("lang", "text", "n_words").unionByName(spark.createDataFrame([(*r, 1) for r in more], "lang string, text string, n_words long"))
    for shard, piece, most in ((1_000_000, 2_000_000, 50), (40, 30, 7)):
        monkeypatch.setattr(phrases, "SHARD", shard)
        monkeypatch.setattr(phrases, "SLICE", piece)
        assert sorted(map(tuple, phrases.collocations(src, least=3, most=most).collect())) == brute_phrases(rows + more, 3, most)
    assert sorted(map(tuple, phrases.collocations(src, least=4, share=60).collect())) == brute_phrases(rows + more, 4, 2000, 60)
    assert phrases.collocations(empty).count() == 0


def test_phrases_are_the_sql_ones(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op13_phrases", "documents")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 3), st.integers(3, 6))
def test_ngrams_of_a_suffix_array(ids, low, high):
    want = {k: Counter(tuple(ids[a : a + k]) for a in range(len(ids) - k + 1) if 0 not in ids[a : a + k]) for k in range(low, high + 1)}
    got = phrases.ngrams(np.array(ids, np.int32), range(low, high + 1))
    assert {k: {tuple(ids[p : p + k]): int(c) for p, c in zip(*x)} for k, x in got.items()} == want


def test_scores_pass_64_bits(spark):
    big = 1 << 45
    rows = [("en", 1, "a", 2 * big), ("en", 1, "b", 3 * big), ("en", 2, "a b", big)]
    out = phrases.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long"), spark.createDataFrame([("en", 1 << 50)], "lang string, n long")).first()
    assert out["score"] == 1000 * big * (1 << 50) // (6 * big * big)
