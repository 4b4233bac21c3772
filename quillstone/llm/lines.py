"""Operator 7: drops lines that many documents share, by probing a sharded minimal perfect hash.

Lines' keys are counted over all documents by a 128-bit hash, with partial counts in each task. The
hashes found often enough are dealt into shards; each shard is a minimal perfect hash (levels of bits in
which each key has a place of its own, ranked by population counts) that indexes three compact arrays:
a 64-bit fingerprint, the count and the largest doc_id. The shards' size is counted: up to INDEX_BYTES
they are broadcast and documents probe the arrays as they are read, with no shuffle of lines or texts.
A larger index isn't sent everywhere: each document's distinct hashes are dealt to the shards, a shard's
in as many parts as their number asks for, and probe the arrays there; only what goes comes back.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sieve, documents, spread, unused, written

#: Largest index, in bytes, that is broadcast to the executors.
INDEX_BYTES = 128_000_000
#: Bytes of index for a key, at most: fingerprint, count, doc_id, and the perfect hash.
KEY_BYTES = 22
#: Keys of a shard, on average.
SHARD_KEYS = 500_000

#: Hashes that one task probes a shard with, about, where shards aren't sent everywhere.
PART_HASHES = 4_000_000

#: A null doc_id counts as one document, before all others.
NO_ID = -(1 << 63)
_SPACE = b" \t\n\v\f\r"


def keys(text: str | None, least: int) -> list[bytes | None]:
    """The key of each \\n-split line, None where it has fewer than `least` code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode().lower().split(b"\n"):  # lower() of bytes changes A-Z only
        k = line.strip(_SPACE)
        long = len(k) >= least and (k.isascii() or len(k) >= 4 * least or len(k.decode()) >= least)
        out.append(k if long else None)
    return out


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    h = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: find() gives each key its own number below len(keys)."""

    def __init__(self, keys: np.ndarray, room: float = 2.0, most: int = 48):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, first = keys, 0
        while len(left) and len(self.levels) < most:
            size = max(64, int(len(left) * room) // 64 * 64)
            at = _mix(left, len(self.levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, first + np.cumsum(ones) - ones))
            first += int(ones.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.rest = {int(k): first + n for n, k in enumerate(left)}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 for some keys that aren't there; others that aren't there get any number."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = _mix(keys[left], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        for k in left:
            out[k] = self.rest.get(int(keys[k]), -1)
        return out


class Shard:
    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.hash = PerfectHash(h1)
        at = self.hash.find(h1)
        self.fingerprints, self.counts, self.last = np.empty_like(h2), np.empty(len(h1), "<u4"), np.empty_like(last)
        self.fingerprints[at], self.counts[at], self.last[at] = h2, np.minimum(counts, (1 << 32) - 1), last

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest doc_id) of each line hash; count 0 if it isn't there."""
        at = self.hash.find(h1)
        there = (at >= 0) & (self.fingerprints[at] == h2)
        return np.where(there, self.counts[at], 0), np.where(there, self.last[at], 0)


def _hashes(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in found), "<u8").reshape(-1, 2)


def _counted(least: int, by_document: bool):
    """by_document: a row for each document and hash; else partial counts of what the task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: dict[bytes, list[int]]) -> pa.RecordBatch:
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            n = np.array([*found.values()], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], n[:, 0], n[:, 1])], names=["h1", "h2", "n", "last"])

        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = NO_ID if i is None else i
                for k in {xxhash.xxh3_128_digest(k) for k in keys(text, least) if k is not None}:
                    if by_document:
                        found[k + i.to_bytes(8, "little", signed=True)] = [1, i]
                    elif k in found:
                        found[k][0] += 1
                        found[k][1] = max(found[k][1], i)
                    else:
                        found[k] = [1, i]
            if by_document:
                h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], np.ones(len(h), np.int64), h[:, 2])], names=["h1", "h2", "n", "last"])
            else:
                yield out(found)

    return run


def frequent(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """h1, h2, n, last of the lines with a key of least_chars that least_docs documents hold."""
    src, shape = spread(documents(docs)), "h1 long, h2 long, n long, last long"
    again = documents(docs, "doc_id").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    lines = src.mapInArrow(_counted(least_chars, bool(again)), shape)
    if again:  # rows of the same document count once
        lines = lines.dropDuplicates(["h1", "h2", "last"])
    return lines.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= least_docs)


def index(found: DataFrame, shards: int) -> DataFrame:
    """shard, index (bytes) of rows as frequent() gives them."""

    def build(key, table):
        h1, h2, n, last = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "last"))
        made = Shard(h1.view("<u8"), h2.view("<u8"), n, last)
        return pa.Table.from_pydict({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(made)], pa.binary())})

    return found.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, index binary")


class Dropper:
    """Decides by the broadcast shards which lines of a batch of documents go."""

    def __init__(self, shards: dict[int, bytes], n: int):
        self.n, self.shards = n, {k: pickle.loads(x) for k, x in shards.items()}

    def __call__(self, ids: list, lines: list[list[bytes | None]]) -> list[set[int]]:
        flat = [(d, j, k) for d, ks in enumerate(lines) for j, k in enumerate(ks) if k is not None]
        gone: list[set[int]] = [set() for _ in lines]
        if not flat or not self.shards:
            return gone
        h = _hashes([k for _, _, k in flat])
        shard = h[:, 1].view("<i8") % self.n  # as pmod
        own = np.array([NO_ID if ids[d] is None else ids[d] for d, _, _ in flat], np.int64)
        for s, held in self.shards.items():
            rows = np.flatnonzero(shard == s)
            count, last = held.probe(h[rows, 0], h[rows, 1])
            for r in rows[(count > 0) & (last != own[rows])]:
                gone[flat[r][0]].add(flat[r][1])
        return gone


_held: dict[str, Dropper] = {}  # of this worker


def _drop(docs: DataFrame, least_chars: int, least_docs: int, finish, schema, columns: list[str]) -> DataFrame:
    """finish(batch, ids, texts, lines dropped) -> batch, run where documents are read."""
    spark = docs.sparkSession
    found = written(frequent(docs, least_chars, least_docs))
    n = found.count()
    src = spread(docs.select(*[F.col(f"`{c}`") for c in columns]))
    if n * KEY_BYTES <= INDEX_BYTES:
        shards = -(-n // SHARD_KEYS) or 1
        name = found._quillstone_path
        sent = spark.sparkContext.broadcast((shards, {r["shard"]: bytes(r["index"]) for r in index(found, shards).collect()} if n else {}))

        def run(batches):
            if name not in _held:
                _held.clear()
                _held[name] = Dropper(sent.value[1], sent.value[0])
            for b in batches:
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                yield finish(b, ids, texts, _held[name](ids, [keys(t, least_chars) for t in texts]))

        return src.mapInArrow(run, schema)
    shards = -(-n // SHARD_KEYS)
    own, mark = unused(docs, "own"), unused(docs, "gone")
    gone = _probed(docs, index(found, shards), shards, least_chars).groupBy("own").agg(F.collect_set(F.struct("h1", "h2")).alias(mark)).withColumnRenamed("own", own)
    gone = written(gone)
    at = unused(docs, "hash")
    sieve = spark.sparkContext.broadcast(Sieve.of(gone.select(F.xxhash64(own).alias("h")), gone.count()))
    src = src.withColumn(own, F.coalesce("doc_id", F.lit(NO_ID))).withColumn(at, F.xxhash64(own))

    def only(marked: bool):
        """Documents that may lose a line, or those that surely don't: these aren't shuffled."""

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(sieve.value.has(b.column(at).to_numpy(zero_copy_only=False).view(np.uint64)) == marked))

        return src.mapInArrow(run, src.schema)

    as_read = only(False).withColumn(mark, F.lit(None).cast(gone.schema[mark].dataType))
    src = only(True).join(gone, own, "left").unionByName(as_read).select(*[F.col(f"`{c}`") for c in columns], mark)

    def run_marked(batches):
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            out = []
            for t, g in zip(texts, b.column(mark).to_pylist()):
                g = {(x["h1"], x["h2"]) for x in g or []}
                ks = keys(t, least_chars) if g else []
                out.append({j for j, k in enumerate(ks) if k is not None and tuple(_hashes([k]).view("<i8")[0].tolist()) in g})
            yield finish(b.select(columns), ids, texts, out)

    return src.mapInArrow(run_marked, schema)


def _probed(docs: DataFrame, indexed: DataFrame, shards: int, least: int) -> DataFrame:
    """own, h1, h2 of the line hashes that go, found by probing their shard; a task reads a shard's arrays and
    then hashes as they come, a part of about PART_HASHES of them."""
    lines = written(spread(documents(docs)).mapInArrow(_counted(least, True), "h1 long, h2 long, n long, last long").select("h1", "h2", F.col("last").alias("own")))
    parts = -(-lines.count() // (shards * PART_HASHES)) or 1
    part = F.pmod(F.xxhash64("own"), F.lit(parts)).cast("int").alias("part")
    asked = lines.select(F.pmod("h2", F.lit(shards)).cast("int").alias("shard"), part, F.lit(1).alias("asks"), "h1", "h2", "own", F.lit(None).cast("binary").alias("index"))
    none = [F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "own")]
    held = indexed.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("asks"), *none, "index")

    def run(batches):
        at, shard = None, None
        for b in batches:
            keys_of = list(zip(b.column("shard").to_pylist(), b.column("part").to_pylist(), b.column("asks").to_pylist()))
            start = 0
            while start < len(keys_of):
                end = start
                while end < len(keys_of) and keys_of[end] == keys_of[start]:
                    end += 1
                rows = b.slice(start, end - start)
                if keys_of[start][2] == 0:
                    at, shard = keys_of[start][:2], pickle.loads(rows.column("index")[0].as_py())
                elif at == keys_of[start][:2]:
                    h1, h2, own = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2", "own"))
                    count, last = shard.probe(h1.view("<u8"), h2.view("<u8"))
                    k = np.flatnonzero((count > 0) & (last != own))
                    yield pa.RecordBatch.from_pydict({"own": pa.array(own[k]), "h1": pa.array(h1[k]), "h2": pa.array(h2[k])})
                start = end

    return held.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "asks").mapInArrow(run, "own long, h1 long, h2 long")


def _kept(text: str | None, gone: set[int]) -> str | None:
    return "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone) if gone else text


def drop_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """docs, with all its columns, without lines whose key (ends stripped of white space, A-Z lowered) has
    least_chars code points or more and is held by least_docs documents or more; the largest doc_id that
    holds it keeps its lines. n_chars, if docs has it, follows the text.

    Null texts stay null. Rows of one doc_id are one document; a null doc_id is a document before all
    others. Equal lines of one document stay or go together. Other columns stay as they are.
    """

    def finish(b, ids, texts, gone):
        new = [_kept(t, g) for t, g in zip(texts, gone)]
        b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))
        at = b.schema.get_field_index("n_chars")
        if at >= 0:
            n = [old if not g else len(t) for old, t, g in zip(b.column(at).to_pylist(), new, gone)]
            b = b.set_column(at, "n_chars", pa.array(n, b.schema.field(at).type))
        return b

    return _drop(docs, least_chars, least_docs, finish, docs.schema, docs.columns)


def report(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of docs (null text: empty), by drop_lines()'s rules."""

    def finish(b, ids, texts, gone):
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": b.column("doc_id"),
                "n_lines": pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()),
                "n_dropped": pa.array([len(g) for g in gone], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256((_kept(t, g) or "").encode()).hexdigest() for t, g in zip(texts, gone)], pa.string()),
            }
        )

    return _drop(docs, least_chars, least_docs, finish, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", ["doc_id", "text"])


#: DuckDB's form of report() over the view documents.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
    LATERAL (SELECT unnest(d.l) AS line, unnest(range(1, len(d.l) + 1)) AS n) u
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT a.doc_id, a.line, a.n, (o.k IS NOT NULL AND o.last <> a.doc_id) AS gone FROM keyed a LEFT JOIN often o ON a.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
