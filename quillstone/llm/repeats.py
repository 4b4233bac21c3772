"""Operator 10: repeated byte strings, by sorting one bucket of suffixes at a time.

Only strings of `length` bytes that come again matter, so suffixes are compared to that depth. Buckets are
made by content: a suffix belongs to the least mixed hash of the K-grams in its first `length` bytes, at
the leftmost place (its anchor), so equal strings share a bucket and lie alike around their anchors. Hashes
that come only once in the corpus make no bucket. A bucket's row is the context of an anchor: the bytes
that all suffixes with this anchor reach. Equal contexts are told apart from the first one where they are
read; the others meet by bucket, in blocks of bounded size, and there suffixes are sorted. Places at
multiples of V from the anchor are the cover sample: as equal suffixes have equal places relative to their
anchors, one residue covers all pairs. The sample's ranks are computed first, by doubling, and ties of
suffixes beyond their first and last bytes are resolved by them.

A bucket of more than CHUNK contexts is cut into chunks; what is first in its chunk meets the other
chunks' firsts by a 128-bit hash of the string, in an aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sieve, documents, dropped, portions, small_join, spread, unused, written

LENGTH = 100
K = 24
#: Distance of the cover sample's places; 5 * V is LENGTH.
V = 20
#: Contexts of a bucket that are sorted together, and of a block of buckets.
CHUNK, BLOCK = 3_000, 3_000
#: Contexts that a task compares where they are read, before it passes them on.
PENDING = 30_000
#: Hashes that come again up to which a bitmap of fixed size tells them where documents are read; beyond,
#: they are joined to the documents.
SIEVE_ROWS = 30_000_000
#: A null doc_id comes before all others.
NO_ID = -(1 << 63)
_PORTION = 1 << 22
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(pow(_BASE, -1, 1 << 64), k, 1 << 64))])
        return self.up, self.down


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(b: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of each anchor: the strings that start at first ... last have it."""
    whole, out = np.frombuffer(b, np.uint8), []
    w, low = length - K + 1, np.uint64((1 << 24) - 1)
    for s in range(0, max(0, len(whole) - length + 1), _PORTION):
        part = whole[s : s + _PORTION + length - 1]
        up, down = _powers.upto(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
        m = len(part) - K + 1
        h = _mix((sums[K:] - sums[:m]) * down[:m])
        v = (h & ~low) | np.arange(m, dtype=np.uint64)  # the leftmost of equal ones is the least
        pad = -m % w
        blocks = np.concatenate([v, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        at = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], n) - 1
        place = at[first]
        out.append((_mix(h[place] * np.uint64(_BASE)), place + s, first + s, last + s))  # least hashes are small: mixed again
    if not out:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*out)))


def _ids(*keys: np.ndarray) -> np.ndarray:
    """The rank of each row among the distinct rows, in the order of keys (the first one leads)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _sample_ranks(load: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, total: int) -> np.ndarray:
    """By place in the concatenated contexts: the rank of 4 * V bytes at the cover sample's places, else -1."""
    first = anchor % V
    n = np.maximum(0, (sizes - first - V) // V + 1)
    c = np.repeat(np.arange(len(starts)), n)
    q = starts[c] + first[c] + V * (np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n))
    ranks = np.full(total + 8 * V, -1, np.int64)
    ranks[q] = _ids(load[q], load[q + 8], load[q + V - 8])
    ends = (starts + sizes)[c]
    for width in (V, 2 * V):  # doubled: the rank of 2 * width bytes from two of width
        ok = q + 2 * width <= ends
        q, ends = q[ok], ends[ok]
        longer = np.full(total + 8 * V, -1, np.int64)
        longer[q] = _ids(ranks[q], ranks[q + width])
        ranks = longer
    return ranks


def sort_block(bucket: np.ndarray, doc: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, earlier) of each string: earlier is True if an equal one starts before it in the block.

    bucket: of each context; doc: its document's rank in the corpus's order; anchor, first, last: places.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(contexts) + bytes(16), np.uint8)
    load = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
    ranks = _sample_ranks(load, starts, sizes, anchor - first, int(sizes.sum()))
    n = last - first + 1
    c = np.repeat(np.arange(len(contexts)), n)
    j = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
    x = (anchor - first)[c] - j
    i = starts[c] + j
    rank = ranks[i + x % V]
    start, earlier = first[c] + j, np.zeros(len(c), bool)
    group = _ids(bucket[c] * 256 + x, rank)
    again = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(again):
        i = i[again]
        same = _ids(group[again], load[i], load[i + 8], load[i + V - 8], load[i + length - V], load[i + length - V + 8], load[i + length - 8])
        order = np.lexsort((start[again], doc[c[again]], same))
        s, d, p = same[order], doc[c[again]][order], start[again][order]
        head = np.concatenate([[True], s[1:] != s[:-1]])
        at = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
        earlier[again[order]] = (d != d[at]) | (p != p[at])  # the same place read twice isn't earlier
    return c, start, earlier


def _runs(c: np.ndarray, start: np.ndarray, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, from, to) of the bytes that marked strings cover, strings side by side as one."""
    k = np.flatnonzero(marked)
    if not len(k):
        return k, k, k
    new = np.concatenate([[True], (c[k][1:] != c[k][:-1]) | (start[k][1:] != start[k][:-1] + 1)])
    end = np.append(np.flatnonzero(new)[1:], len(k)) - 1
    return c[k][new], start[k][new], start[k][end] + length


_ROW = "h long, id long, th long, anchor long, first long, last long, context binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """id, th, text: a document is its doc_id and, for rows that share one, its text's hash."""
    return documents(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def _hash_counts(src: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in portions(batches):
            found = [anchors(t.encode(), length)[0] for t in b.column("text").to_pylist()]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return src.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _contexts(src: DataFrame, sieve, length: int) -> DataFrame:
    """Rows of _ROW, or, with context null, (id, th, first, last): strings that come earlier in the batch.

    sieve: tells the hashes that may come again; None: src's column `wanted` holds them for each document.
    """

    def flush(out: list, gone: list):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        if gone:
            i, th, f, e = zip(*gone)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([0] * len(gone), i, th, f, f, e, [None] * len(gone)), kinds)], names=names)

    def run(batches):
        for b in portions(batches):
            seen, out, gone = set(), [], []
            wanted = b.column("wanted") if sieve is None else None
            rows = sorted(zip(b.column("id").to_pylist(), b.column("th").to_pylist(), range(b.num_rows)))
            texts, before = b.column("text"), None
            for i, th, k in rows:
                if (i, th) == before:
                    continue  # the same document again
                before, t = (i, th), texts[k].as_py().encode()
                h, place, first, last = anchors(t, length)
                hit = np.flatnonzero(sieve.value.has(h) if sieve is not None else np.isin(h.view(np.int64), np.array(wanted[k].as_py() or [], np.int64)))
                for hh, p, f, e in zip(h[hit].view(np.int64).tolist(), place[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                    ctx = t[f : e + length]
                    key = (hh, p - f, ctx)
                    if key in seen:
                        if gone and gone[-1][:2] == (i, th) and f <= gone[-1][3] + 1:
                            gone[-1] = (i, th, gone[-1][2], e)  # strings side by side
                        else:
                            gone.append((i, th, f, e))
                    else:
                        seen.add(key)
                        out.append((hh, i, th, p, f, e, ctx))
                if len(out) + len(gone) >= PENDING:
                    yield from flush(out, gone)
                    seen, out, gone = set(), [], []
            yield from flush(out, gone)

    names = [x.split()[0] for x in _ROW.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return src.mapInArrow(run, _ROW)


def _sorted_blocks(rows: DataFrame, length: int) -> DataFrame:
    """id, th, from, to of bytes that come earlier; rows with key1, key2 are strings that are first in
    their chunk of a large bucket, where other chunks may have an earlier one."""

    def run(batches):
        held: list[tuple] = []

        def flush():
            h, chunk, i, th, anchor, first, last, ctx = zip(*held)
            keys = {k: n for n, k in enumerate(dict.fromkeys(zip(h, chunk)))}
            bucket = np.array([keys[k] for k in zip(h, chunk)])
            doc_keys = {k: n for n, k in enumerate(sorted(set(zip(i, th))))}
            doc = np.array([doc_keys[k] for k in zip(i, th)])
            c, start, earlier = sort_block(bucket, doc, np.array(anchor), np.array(first), np.array(last), list(ctx), length)
            rc, a, z = _runs(c, start, earlier, length)
            none = pa.nulls(len(rc), pa.int64())
            ii, tt = np.array(i), np.array(th)
            yield pa.RecordBatch.from_arrays([pa.array(ii[rc]), pa.array(tt[rc]), pa.array(a), pa.array(z), none, none], names=names)
            big = np.array(chunk)[c] >= 0
            k = np.flatnonzero(big & ~earlier)
            for p in range(0, len(k), 200_000):
                kk = k[p : p + 200_000]
                digest = b"".join(xxhash.xxh3_128_digest(ctx[x][s - first[x] : s - first[x] + length]) for x, s in zip(c[kk].tolist(), start[kk].tolist()))
                d = np.frombuffer(digest, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ii[c[kk]]), pa.array(tt[c[kk]]), pa.array(start[kk]), pa.array(start[kk] + length), pa.array(d[:, 0]), pa.array(d[:, 1])], names=names)
            held.clear()

        own: list[tuple] = []  # of the bucket that is being read

        def close():
            if len(own) > 1 or (own and own[0][1] >= 0):
                held.extend(own)
            own.clear()

        for b in batches:
            for row in zip(*(b.column(x).to_pylist() for x in order)):
                if own and own[0][:2] != row[:2]:
                    close()
                    if len(held) >= BLOCK:
                        yield from flush()
                own.append(row)
        close()
        if held:
            yield from flush()

    order = ["h", "chunk", "id", "th", "anchor", "first", "last", "context"]
    names = ["id", "th", "from", "to", "key1", "key2"]
    return rows.repartition("h", "chunk").sortWithinPartitions("h", "chunk").mapInArrow(run, "id long, th long, from long, to long, key1 long, key2 long")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, th, spans (from, to; in no order, overlapping) of documents with bytes that are covered by
    strings of `length` bytes that also start earlier."""
    src = spread(_keyed(docs))
    often = written(_hash_counts(src, length).filter("n > 1"))
    n = often.count()
    if n <= SIEVE_ROWS:
        sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(often.select("h"), n))
        found = _contexts(src, sieve, length)
    else:
        def hashes(batches):
            for b in batches:
                for i, th, t in zip(*(b.column(k).to_pylist() for k in ("id", "th", "text"))):
                    h = np.unique(anchors(t.encode(), length)[0]).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"h": pa.array(h), "id": pa.array([i] * len(h), pa.int64()), "th": pa.array([th] * len(h), pa.int64())})

        wanted = src.mapInArrow(hashes, "h long, id long, th long").join(often.select("h"), "h").groupBy("id", "th").agg(F.collect_set("h").alias("wanted"))
        found = _contexts(src.join(wanted, ["id", "th"]), None, length)
    found = written(found)
    large = written(often.filter(F.col("n") > CHUNK).select("h", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    rows = small_join(found.filter("context IS NOT NULL"), large, ["h"])
    rows = rows.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("id", "th", "first"), F.col("chunks")).cast("int"), F.lit(-1))).drop("chunks")
    marked = written(_sorted_blocks(rows, length))
    firsts = marked.filter("key1 IS NOT NULL")
    least = firsts.groupBy("key1", "key2").agg(F.min(F.struct("id", "th", "from")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key1", "key2", "first")
    later = firsts.join(least, ["key1", "key2"]).filter(F.struct("id", "th", "from") != F.col("first"))
    spans = found.filter("context IS NULL").select("id", "th", F.col("first").alias("from"), (F.col("last") + length).alias("to"))
    spans = spans.unionByName(marked.filter("key1 IS NULL").select("id", "th", "from", "to")).unionByName(later.select("id", "th", "from", "to"))
    out = written(spans.groupBy("id", "th").agg(F.collect_list(F.struct("from", "to")).alias("spans")))
    for x in (often, found, large, marked):
        dropped(x)
    return out


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((s["from"], s["to"]) for s in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def _kept(b: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, z in spans:
        out.append(b[at:a])
        at = z
    return b"".join([*out, b[at:]])


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; null texts are empty.

    Texts of fewer than `length` bytes stay whole. Rows that share a doc_id are documents in the order of
    their texts' hashes; equal rows are one document and give equal rows. Other columns are ignored.
    """
    found = repeats(docs, length)
    n = found.count()
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(found.select(F.xxhash64("id", "th").alias("h")), n))

    def ready(batches):
        for b in portions(batches):
            may = sieve.value.has(b.column("h").to_numpy().view(np.uint64))
            texts = b.column("text").to_pylist()
            raw = [t.encode() for t in texts]
            sha = [None if m else hashlib.sha256(x).hexdigest() for m, x in zip(may, raw)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(map(len, raw), pa.int64()), pa.array(sha, pa.string()), pa.array([x if m else None for m, x in zip(may, raw)], pa.binary())], names=["id", "th", "n_bytes", "sha", "raw"])

    def finish(batches):
        for b in portions(batches):
            removed, runs, sha = [], [], b.column("sha").to_pylist()
            for k, (raw, spans) in enumerate(zip(b.column("raw").to_pylist(), b.column("spans").to_pylist())):
                s = merged(spans)
                runs.append(len(s))
                removed.append(sum(z - a for a, z in s))
                if sha[k] is None:
                    sha[k] = hashlib.sha256(_kept(raw, s)).hexdigest()
            own = [None if i == NO_ID else i for i in b.column("id").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, pa.int64()), "n_bytes": b.column("n_bytes"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    src = spread(_keyed(docs)).withColumn("h", F.xxhash64("id", "th"))
    rows = src.mapInArrow(ready, "id long, th long, n_bytes long, sha string, raw binary").join(found, ["id", "th"], "left")
    return rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, with all its columns, without those bytes; cut characters at a span's ends go too."""
    found, columns = repeats(docs, length), docs.columns
    own, th, held = (unused(docs, n) for n in ("id", "th", "spans"))
    keyed = docs.withColumn(own, F.coalesce("doc_id", F.lit(NO_ID))).withColumn(th, F.xxhash64("text"))
    rows = keyed.join(found.select(F.col("id").alias(own), F.col("th").alias(th), F.col("spans").alias(held)), [own, th], "left")

    def finish(batches):
        for b in batches:
            new = [t if not s else _kept(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(b.column("text").to_pylist(), b.column(held).to_pylist())]
            b = b.select(columns)
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], held).mapInArrow(finish, docs.schema)
