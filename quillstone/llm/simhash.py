"""Operator 12: near-duplicates by SimHash, with fingerprints found by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked if few bits differ. Their bits are grouped into parts, bits that go together in one, and
each fingerprint allots the parts thresholds whose sum is LINKED - parts + 1 (-1: not looked at): if it differed from another in
more bits than its threshold in every part, it would differ in more than LINKED bits. So it looks up, in each part, all values within that
part's threshold, and every link is met. Thresholds come from a dynamic programme over the parts that keeps what is looked up and
compared least, by counts of the values over all fingerprints: a part whose value is common gets -1, and rarer parts make up for it.

Equal fingerprints count once. Values with many members are cut into blocks; a task holds a block and others stream past it. It
gives a link only if it joins two parts of the block that its links haven't joined yet, so no group is expanded into pairs.
The links' connected components give the answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import components
from .shared import documents, dropped, portions, small_join, spread, written

WORDS, SEED, BITS, LINKED = 3, 42, 64, 3
#: Numbers of parts that are weighed against each other.
PARTS = (2, 3, 4)
#: Bits of a part by which its values are counted: 65,536 counts at most.
CELL_BITS = 16
#: What a comparison costs beside a look-up that is shuffled.
COMPARED = 1 / 64
#: Fingerprints that a task holds, and those that stream past them, at most.
BLOCK, STREAM = 4_096, 65_536


def fingerprint(text: bytes | None) -> int:
    """Of the text's shingles of WORDS words (fewer words: all of them): bits that are set in over half of their hashes."""
    words = text.lower().split() if text else []  # of bytes: A to Z, \x20 and \x09-\x0D
    if not words:
        return 0
    whole, width = b" ".join(words), min(WORDS, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    h = np.fromiter([digest(whole[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 16):
        counts += np.unpackbits(h[a : a + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed long) of each row."""

    def run(batches):
        for b in portions(batches):
            fp = np.array([fingerprint(t) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    src = spread(documents(docs))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def together(fps: DataFrame) -> np.ndarray:
    """How strongly each two bits go together over all fingerprints: absolute correlations."""

    def run(batches):
        both = np.zeros((BITS + 1, BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8)).reshape(-1, BITS)[:, ::-1].astype(np.float32)
            both[:BITS] += (bits.T @ bits).astype(np.int64)
            both[BITS] += len(bits)
        i, j = np.indices(both.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, both)], names=["i", "j", "n"])

    both = np.zeros((BITS + 1, BITS))
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = r["n"]
    n = max(1.0, both[BITS, 0])
    p = np.diag(both) / n
    spread_ = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both[:BITS] / n - np.outer(p, p)) / np.outer(spread_, spread_)).clip(0, 1)


def grouped(strength: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in so many parts of about one size: each begins with the bit that goes with most of those left, and takes
    the one that goes best with what it has."""
    left, out = set(range(BITS)), []
    for k in range(parts):
        most = (len(left) + parts - k - 1) // (parts - k)
        own = [max(sorted(left), key=lambda b: sum(strength[b][sorted(left)]))]
        left -= set(own)
        while len(own) < most:
            own.append(max(sorted(left), key=lambda b: sum(strength[b][own])))
            left.remove(own[-1])
        out.append(own)
    return out


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


@dataclass
class Layout:
    """Parts of bits and what thresholds from 0 to LINKED cost in them: by part, threshold and cell."""

    parts: list[list[int]]
    costs: list[np.ndarray]
    linked: int

    @classmethod
    def of(cls, parts: list[list[int]], counts: list[np.ndarray], linked: int) -> Layout:
        costs, cells = [], np.arange(1 << CELL_BITS)
        for bits, n in zip(parts, counts):
            shells = [sum((n[cells ^ sum(1 << b for b in c)] for c in combinations(range(CELL_BITS), a)), np.zeros(len(n))) for a in range(linked + 1)]
            rest = len(bits) - CELL_BITS
            within = [sum(comb(rest, b) for b in range(t + 1)) / 2**rest for t in range(linked + 1)]  # of the bits beyond a cell's
            met = [sum(shells[a] * within[t - a] for a in range(t + 1)) for t in range(linked + 1)]
            looked = [sum(comb(len(bits), a) for a in range(t + 1)) for t in range(linked + 1)]
            costs.append(np.stack([x + COMPARED * m for x, m in zip(looked, met)]))
        return cls(parts, costs, linked)

    def thresholds(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a threshold for each fingerprint and part, of least cost; these costs)."""
        m, total = len(self.parts), self.linked - len(self.parts) + 1
        low, high = -m, self.linked + m  # sums of thresholds that are kept
        cost = np.full((high - low + 1, len(fp)), np.inf)
        cost[-low] = 0
        picks = []
        for bits, costs in zip(self.parts, self.costs):
            own = costs[:, values(fp, bits) & ((1 << CELL_BITS) - 1)]
            new, pick = np.full_like(cost, np.inf), np.zeros(cost.shape, np.int8)
            for s in range(len(cost)):
                for t in range(-1, self.linked + 1):
                    if 0 <= s - t < len(cost):
                        c = cost[s - t] + (own[t] if t >= 0 else 0)
                        better = c < new[s]
                        new[s][better], pick[s][better] = c[better], t
            cost = new
            picks.append(pick)
        out, s, at = np.empty((m, len(fp)), np.int8), np.full(len(fp), total - low), np.arange(len(fp))
        for k in range(m - 1, -1, -1):
            out[k] = picks[k][s, at]
            s = s - out[k]
        return out, cost[total - low]


def _counts(fps: DataFrame, layouts: list[list[list[int]]]) -> list[list[np.ndarray]]:
    """How many fingerprints have each cell of each part of each layout."""
    flat = [bits for parts in layouts for bits in parts]

    def run(batches):
        n = np.zeros((len(flat), 1 << CELL_BITS), np.int64)
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k, bits in enumerate(flat):
                n[k] += np.bincount(values(fp, bits[:CELL_BITS]), minlength=1 << CELL_BITS)
        part, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cell), pa.array(n[part, cell])], names=["part", "cell", "n"])

    def packed(table):
        n = np.zeros(1 << CELL_BITS, np.int64)
        n[table.column("cell").to_numpy()] = table.column("n").to_numpy()
        return pa.Table.from_pydict({"part": table.column("part").combine_chunks()[:1], "n": pa.array([n.tobytes()], pa.binary())})

    sums = fps.select("fp").mapInArrow(run, "part long, cell long, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    found = {r["part"]: np.frombuffer(bytes(r["n"]), np.int64) for r in sums.groupBy("part").applyInArrow(packed, "part long, n binary").collect()}
    found = iter([found.get(k, np.zeros(1 << CELL_BITS, np.int64)) for k in range(len(flat))])
    return [[next(found) for _ in parts] for parts in layouts]


def layout(fps: DataFrame, linked: int = LINKED) -> Layout:
    """The number of parts, their bits and costs, for which all look-ups and comparisons cost least."""
    strength = together(fps)
    tried = [grouped(strength, m) for m in PARTS]
    made = [Layout.of(parts, n, linked) for parts, n in zip(tried, _counts(fps, tried))]
    held = fps.sparkSession.sparkContext.broadcast(made)

    def run(batches):
        total = np.array([0.0] * len(held.value))
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            total += [x.thresholds(fp)[1].sum() + len(fp) * len(x.parts) for x in held.value]
        yield pa.RecordBatch.from_pydict({"which": pa.array(range(len(total)), pa.int32()), "cost": pa.array(total)})

    costs = {r["which"]: r["cost"] for r in fps.select("fp").mapInArrow(run, "which int, cost double").groupBy("which").agg(F.sum("cost").alias("cost")).collect()}
    return made[min(costs, key=lambda k: (costs[k], k))] if costs else made[-1]


def _looked_up(fps: DataFrame, plan: Layout) -> DataFrame:
    """part, value, looks, fp: each fingerprint under its values (looks: false) and under all that it looks up."""
    held = fps.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        plan = held.value
        near = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(bits)), a)], np.int64) for a in range(plan.linked + 1)] for bits in plan.parts]
        for b in portions(batches, 10_000):
            signed = b.column(0).to_numpy()
            fp = signed.view(np.uint64)
            most, _ = plan.thresholds(fp)
            for k, bits in enumerate(plan.parts):
                own = values(fp, bits)
                found = [(own, False, signed)]
                for a in range(plan.linked + 1):
                    far = most[k] >= a
                    v = own[far][:, None] ^ near[k][a][None, :]
                    found.append((v.ravel(), True, np.repeat(signed[far], v.shape[1])))
                for v, looks, who in found:
                    for at in range(0, len(v), 100_000):
                        n = len(v[at : at + 100_000])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(v[at : at + n]), pa.array(np.full(n, looks)), pa.array(who[at : at + n])], names=["part", "value", "looks", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, value long, looks boolean, fp long")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """part, value, block, stream, looks, fp: values with many rows are cut into blocks, what looks them up into streams;
    each block meets each stream."""
    pieces = lambda flag, most: F.greatest(F.ceil(F.count_if(flag) / most), F.lit(1)).cast("int")
    heavy = rows.groupBy("part", "value").agg(pieces(~F.col("looks"), BLOCK).alias("blocks"), pieces(F.col("looks"), STREAM).alias("streams")).filter("blocks > 1 OR streams > 1")
    out = small_join(rows, written(heavy), ["part", "value"]).withColumns({c: F.coalesce(c, F.lit(1)) for c in ("blocks", "streams")})
    own = lambda n: F.array(F.pmod(F.xxhash64("fp"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    out = out.withColumn("block", F.explode(F.when(F.col("looks"), every("blocks")).otherwise(own("blocks"))))
    out = out.withColumn("stream", F.explode(F.when(F.col("looks"), own("streams")).otherwise(every("streams"))))
    return out.select("part", "value", "block", "stream", "looks", "fp")


class _Block:
    """Fingerprints of a value, and which of them links have joined."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.root = fp, np.arange(len(fp))

    def linked(self, looking: np.ndarray, linked: int) -> list[tuple[int, int]]:
        """Links of those that are looking with the block: one for each joined part of it that they are near."""
        out = []
        for k in range(0, len(looking), step := max(1, 2_000_000 // max(1, len(self.fp)))):
            some = looking[k : k + step]
            apart = some[:, None] ^ self.fp[None, :]
            near = (np.bitwise_count(apart) <= linked) & (apart != 0)
            for i in np.flatnonzero(near.any(axis=1)):
                at = np.flatnonzero(near[i])
                roots, first = np.unique(self.root[at], return_index=True)
                out += [(int(some[i]), int(self.fp[j])) for j in at[first]]
                for r in roots[1:]:
                    self.root[self.root == r] = roots[0]
        return out


def links(fps: DataFrame, linked: int = LINKED) -> DataFrame:
    """a, b: links that join all fingerprints (column fp, each once) that chains of at most `linked` differing bits join."""
    rows = written(_looked_up(fps, layout(fps, linked)))
    key = ["part", "value", "block", "stream"]
    dealt = _in_blocks(rows).repartition(*key).sortWithinPartitions(*key, "looks")

    def run(batches):
        at, held, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
            looks, fp = b.column("looks").to_numpy(zero_copy_only=False), b.column("fp").to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)] if len(keys) else [0]
            out = []
            for x, y in zip(cuts, cuts[1:]):
                if (now := tuple(keys[x].tolist())) != at:
                    at, held, block = now, [], None
                middle = x + int(np.searchsorted(looks[x:y], True))
                if middle > x:
                    held.append(fp[x:middle])
                if middle < y and held:
                    block = block or _Block(np.concatenate(held))
                    if y - middle > 1 or len(block.fp) > 1 or fp[middle] != block.fp[0]:
                        out += block.linked(fp[middle:y], linked)
            both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.ascontiguousarray(both[:, 0])), "b": pa.array(np.ascontiguousarray(both[:, 1]))})

    out = written(dealt.mapInArrow(run, "a long, b long").distinct())
    dropped(rows)
    return out


def near_copies(docs: DataFrame, linked: int = LINKED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach) of each row.

    Null and empty texts and those without a word have the fingerprint zero and are linked like any other. Rows of one doc_id
    are rows of their own; a null doc_id is no component_id unless nothing else is in the component. An empty table gives
    an empty one; other columns are ignored.
    """
    rows = written(fingerprints(docs))
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(fps, linked)
    if found.isEmpty():
        named = fps.select("fp", F.col("least").alias("component_id"))
    else:
        classes = components(found).withColumnsRenamed({"node": "fp"})
        own = fps.join(classes, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
        named = own.join(own.groupBy("class").agg(F.min("least").alias("component_id")), "class").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
