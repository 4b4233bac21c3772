"""Operator 6: near-duplicates by order MinHash, with candidates verified by banded alignment.

A document is the sequence of its five-word shingles, each labelled by how many equal ones come before
it, so that labels are unique in a document. Each of SKETCHES hash functions picks the PICKED smallest
labelled shingles and retains them in text order: documents agree on a sketch if they share these
shingles and their order, which is as likely as their edit similarity is high. Two sequences of up to SHORT
shingles also agree on what is left of them without those that may be unaligned: these are found for certain.

Equal texts count once. Documents that agree on a sketch form a bucket. A bucket isn't expanded into
pairs: each of its documents is compared with the bucket's hub, the one that agrees with most others over
all sketches. Buckets that this leaves in several classes are finished in blocks: what isn't of the largest
class meets all members, a task holding a bounded block of the one and reading the other past it, so that
every pair of two classes is decided, and none is a row. Shingles that a pair has in common are counted by an
index of the block; pairs with enough of them are aligned within the band that the threshold leaves. The
links' connected components are the classes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Sieve, documents, dropped, portions, spread, unused, written

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 32
PICKED = 5
#: Shingles up to which a sequence is also hashed without each set of those that may be unaligned.
SHORT = 14
#: Documents, and shingles, of a block that others of its bucket are compared with: what a task holds.
BLOCK, BLOCK_SHINGLES = 256, 4_000_000
#: Partners of a hub that one task compares.
PORTION = 400
#: A null doc_id is a document of its own, before all others.
NO_ID = -(1 << 63)

_word = re.compile(r"\w+")
_seeds = np.random.default_rng(71).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def sequence(text: str | None) -> np.ndarray:
    """The labelled shingles of a text, in order: lower-cased words of letters, digits and underscores.
    Texts of fewer than five words are one shingle; those without a word none."""
    words = _word.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(w))
    n, s = len(w) - width + 1, np.zeros(len(w) - width + 1, np.uint64)
    for k in range(width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    s = _mix(s)
    order = np.argsort(s, kind="stable")
    run = s[order]
    new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    if len(new) < n:
        nth = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
        label = np.empty(n, np.uint64)
        label[order] = nth.astype(np.uint64)
        s = _mix(s + label * np.uint64(0xC2B2AE3D27D4EB4F))
    return s


def sketches(s: np.ndarray) -> np.ndarray:
    """SKETCHES hashes, each of the PICKED least shingles of a sequence in their order."""
    out, n = np.empty(SKETCHES, np.uint64), min(PICKED, len(s))
    for a in range(0, SKETCHES, step := max(1, min(SKETCHES, 400_000 // max(1, len(s))))):
        h = _mix(s[None, :] * _seeds[a : a + step, None])
        at = np.argpartition(h, n - 1, axis=1)[:, :n] if n < len(s) else np.tile(np.arange(n), (len(h), 1))
        picked = s[np.sort(at, axis=1)]
        x = np.zeros(len(h), np.uint64)
        for k in range(n):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + picked[:, k])
        out[a : a + step] = x
    return out


@lru_cache(None)
def _kept(n: int) -> list[np.ndarray]:
    """Places that stay of n, a row for each choice, by how many go: at most the share that SIMILARITY leaves."""
    most = int(n * (1 - SIMILARITY) + 1e-9)
    return [np.array(list(combinations(range(n), n - k))) for k in range(most + 1)]


def remainders(s: np.ndarray) -> np.ndarray:
    """Hashes of all that an alignment of SIMILARITY can leave of a sequence of up to SHORT shingles; of longer
    ones none. Two such sequences that are similar have one in common: the aligned shingles."""
    if not 0 < len(s) <= SHORT:
        return np.empty(0, np.uint64)
    out = []
    for at in _kept(len(s)):
        x = np.zeros(len(at), np.uint64)
        for k in range(at.shape[1]):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + s[at[:, k]])
        out.append(x)
    return np.unique(np.concatenate(out))


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all, from 0 to 1, where the alignment stays within the band: a pair as similar
    as `least` has at most that many unaligned shingles. 0 if it can't reach `least`."""
    total = len(a) + len(b)
    if not total or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = int(total * (1 - least) / (1 + least)) + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if len(i) < least * (total - len(i)):
        return 0.0
    j = j[np.argsort(i)]
    if len(j) > 1 and not (np.diff(j) > 0).all():  # longest ascending chain of places
        ends: list[int] = []
        for x in j.tolist():
            k = bisect_left(ends, x)
            ends[k : k + 1] = [x]
        n = len(ends)
    else:
        n = len(j)
    return n / (total - n)


def _sketched(docs: DataFrame) -> DataFrame:
    """id, h1, h2 (the text's hash), shingles (how many), sketches (and after them remainders) of each row that has a text with a word."""

    def run(batches):
        for b in portions(batches):
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = sequence(t)
                if len(s):
                    out.append((i, xxhash.xxh3_128_digest(t), np.concatenate([sketches(s), remainders(s)]).view(np.int64), len(s)))
            h = np.frombuffer(b"".join(x[1] for x in out), "<i8").reshape(-1, 2)
            flat = np.concatenate([x[2] for x in out]) if out else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[2]) for x in out)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([x[3] for x in out], pa.int32()), lists], names=["id", "h1", "h2", "shingles", "sketches"])

    src = spread(documents(docs)).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    return src.mapInArrow(run, "id long, h1 long, h2 long, shingles int, sketches array<long>")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, text of the documents whose id is among nodes; most others go where they are read."""
    src = documents(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text").filter("text IS NOT NULL").withColumn("h", F.xxhash64("id"))
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(nodes.select(F.xxhash64("node").alias("h")), nodes.count()))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sieve.value.has(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)))).select(["id", "text"])

    return src.mapInArrow(run, "id long, text string").join(nodes.select(F.col("node").alias("id")), "id", "left_semi")


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """hub, node of those pairs that are similar. pairs: distinct hub, node; texts: id, text."""
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions"))
    dealt = pairs.join(counts, "hub").withColumn("portion", F.pmod(F.xxhash64("node"), F.col("portions")).cast("int"))
    wanted = dealt.select(F.col("node").alias("id"), "hub", "portion").unionByName(
        counts.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    )
    rows = texts.join(wanted, "id").select("hub", "portion", (F.col("id") != F.col("hub")).alias("partner"), "id", "text")
    rows = rows.repartition("hub", "portion").sortWithinPartitions("hub", "portion", "partner")

    def run(batches):
        at, own = None, None
        for b in portions(batches):
            hubs, nodes = [], []
            for hub, portion, partner, i, text in zip(*(b.column(k).to_pylist() for k in range(5))):
                s = sequence(text)
                if not partner:
                    at, own = (hub, portion), s
                elif at == (hub, portion) and similarity(own, s, least) >= least:
                    hubs.append(hub)
                    nodes.append(i)
            yield pa.RecordBatch.from_pydict({"hub": pa.array(hubs, pa.int64()), "node": pa.array(nodes, pa.int64())})

    return rows.mapInArrow(run, "hub long, node long")


def _open_blocks(own: DataFrame, hubs: DataFrame) -> DataFrame:
    """band, sketch, i, j, id, class, left: the members of buckets that the hubs leave in two classes or more.

    All but the bucket's largest class are `left`, in blocks i of bounded size, and meet all members, in
    chunks j: a pair of the largest class is never looked at, and a row is repeated once for each block of
    the others, not for each partner. The hub was compared with all members already.
    own: band, sketch, node, shingles, class; hubs: h_band, h_sketch, hub.
    """
    rest = own.join(hubs, (F.col("band") == F.col("h_band")) & (F.col("sketch") == F.col("h_sketch")) & (F.col("node") != F.col("hub")))
    rest = written(rest.select("band", "sketch", "node", "shingles", "class"))
    sizes = rest.groupBy("band", "sketch", "class").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    sizes = sizes.groupBy("band", "sketch").agg(F.max_by("class", F.struct("n", "class")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n"), F.max_by("s", F.struct("n", "class")).alias("s_top"), F.sum("s").alias("s"))
    parts = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    sizes = sizes.filter("n > n_top").select("band", "sketch", "top", parts(F.col("n") - F.col("n_top"), F.col("s") - F.col("s_top")).alias("blocks"), parts(F.col("n") / 4, F.col("s") / 4).alias("chunks"))
    held = rest.join(sizes, ["band", "sketch"]).withColumn("h", F.xxhash64("node"))
    i, j = F.pmod("h", F.col("blocks")).cast("int"), F.pmod("h", F.col("chunks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = held.filter("class <> top").select("band", "sketch", i.alias("i"), every("chunks").alias("j"), F.col("node").alias("id"), "class", F.lit(True).alias("left"))
    right = held.select("band", "sketch", every("blocks").alias("i"), j.alias("j"), F.col("node").alias("id"), "class", (F.col("class") != F.col("top")).alias("other"))
    return left.withColumn("other", F.lit(True)).unionByName(right.withColumn("left", F.lit(False)))


class _Block:
    """Members that all others of a bucket are compared with: their shingles, sorted, lead to those that hold them."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.ids, self.roots = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.sketches, self.seqs = np.stack([r[2] for r in rows]), [r[3] for r in rows]
        self.sizes = np.fromiter(map(len, self.seqs), np.int64, len(rows))
        flat = np.concatenate(self.seqs)
        order = np.argsort(flat)
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(rows)), self.sizes)[order]

    def linked(self, band: int, i: int, root: int, other: bool, sketch: np.ndarray, s: np.ndarray, least: float) -> list[int]:
        """Ids of similar members of other classes than root, whose classes become one. Pairs that meet in an
        earlier band are left to it, and two of the smaller classes are compared once."""
        now = (self.roots != root) & (self.ids != i) & (np.minimum(self.sizes, len(s)) >= least * np.maximum(self.sizes, len(s)))
        if other:
            now &= self.ids < i
        if not now.any():
            return []
        now &= ~(self.sketches[:, :band] == sketch[:band]).any(axis=1)
        a, b = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        n = b - a
        both = np.bincount(self.owner[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(self.ids))
        out = []
        for k in np.flatnonzero(now & (both >= least * (self.sizes + len(s) - both))):
            if self.roots[k] != root and similarity(self.seqs[k], s, least) >= least:
                out.append(int(self.ids[k]))
                self.roots[self.roots == self.roots[k]] = root
        return out


def _compared_in_blocks(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """hub, node of similar members that _open_blocks() brings together: enough of them to join their classes."""
    key = ["band", "sketch", "i", "j"]
    rows = texts.join(rows, "id").select(*key, "left", "other", "class", "id", "sketches", "text")
    rows = rows.repartition(*key).sortWithinPartitions(*key, F.col("left").desc(), "id")

    def run(batches):
        at, held, block, roots = None, [], None, {}
        for batch in portions(batches):
            lists = batch.column(batch.schema.get_field_index("sketches"))
            own = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCHES)
            out = []
            columns = (batch.column(c).to_pylist() for c in (*key, "left", "other", "class", "id", "text"))
            for n, (band, sketch, i, j, left, other, cls, node, text) in enumerate(zip(*columns)):
                if (band, sketch, i, j) != at:
                    at, held, block, roots = (band, sketch, i, j), [], None, {}
                s = sequence(text)
                if left:
                    held.append((node, cls, own[n], s))
                    continue
                if not held:  # the hash left this block without a member
                    continue
                block = block or _Block(held)
                found = block.linked(band, node, roots.get(cls, cls), other, own[n], s, least)
                out += [(node, x) for x in found]
                if found:  # a class that was joined to another stays so for the rest of the block
                    for k, (_, c, _, _) in enumerate(held):
                        roots[c] = int(block.roots[k])
            yield pa.RecordBatch.from_pydict({"hub": pa.array([x[0] for x in out], pa.int64()), "node": pa.array([x[1] for x in out], pa.int64())})

    return rows.mapInArrow(run, "hub long, node long")


def components(links: DataFrame) -> DataFrame:
    """node, class (its least node) of all nodes of links (a, b), by large and small stars."""
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(small)
        dropped(large)
        dropped(now)
        now = new
        # done once each node that isn't the least hangs on one node, and that one on none
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
        open_ = ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).filter("ups > 1 OR (ups = 1 AND downs = 1)")
        if open_.isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("class"))).distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id of each row: rows of one class are linked by texts of similarity `least` or more.

    class_id: the least doc_id of the class. Equal texts with a word are alike; null texts and those without
    a word are in a class of their own. Rows of one doc_id are one document, and a null doc_id is one too.
    Ties between hubs go to the lesser doc_id. Other columns are ignored.
    """
    rows = written(_sketched(docs))
    ids = written(rows.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("shingles").alias("shingles"), F.first("sketches").alias("sketches")))
    members = ids.select("node", "shingles", F.posexplode("sketches").alias("band", "sketch")).withColumn("band", F.least("band", F.lit(SKETCHES)))
    sizes = members.groupBy("band", "sketch").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(members.join(sizes, ["band", "sketch"]).distinct())
    degrees = written(met.groupBy("node").agg(F.sum("size").alias("degree")))
    texts = written(_texts_of(docs, degrees).join(ids.select(F.col("node").alias("id"), F.slice("sketches", 1, SKETCHES).alias("sketches")), "id"))
    best = F.max_by("node", F.struct("degree", F.bitwise_not("node"))).alias("hub")
    hubs = written(met.join(degrees, "node").groupBy("band", "sketch").agg(best).withColumnsRenamed({"band": "h_band", "sketch": "h_sketch"}))
    made = [rows, ids, met, degrees, texts, hubs]
    pairs = met.join(hubs, (F.col("band") == F.col("h_band")) & (F.col("sketch") == F.col("h_sketch")) & (F.col("node") != F.col("hub"))).select("hub", "node")
    made.append(pairs := written(pairs.distinct()))
    classes, links = None, None

    def join_classes(found):
        nonlocal classes, links
        made.append(found := written(found.distinct()))
        if not found.isEmpty():
            new = found.select(F.col("hub").alias("a"), F.col("node").alias("b"))
            links = new if classes is None else new.unionByName(classes.select(F.col("node").alias("a"), F.col("class").alias("b")))
            made.append(classes := written(components(links)))

    join_classes(_compared(pairs, texts, least))
    own = met.withColumn("class", F.col("node")) if classes is None else met.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    join_classes(_compared_in_blocks(_open_blocks(own, hubs), texts, least))
    same = rows.join(ids.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node").distinct()
    if classes is not None:
        same = same.join(classes, "node", "left").select("id", F.coalesce("class", "node").alias("class"))
    else:
        same = same.select("id", F.col("node").alias("class"))
    # rows of one doc_id with several texts tie the texts' classes together
    again = same.groupBy("id").count().filter("count > 1").limit(1).count()
    if again:
        tied = written(components(same.select(F.col("id").alias("a"), F.col("class").alias("b"))))
        same = same.select("id").distinct().join(tied.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("class", "id").alias("class"))
    out = written(same)
    for x in made:
        dropped(x)
    own = documents(docs, "doc_id").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    out = own.join(out, "id", "left")
    return out.select("doc_id", F.when(F.coalesce("class", "id") == NO_ID, F.lit(None)).otherwise(F.coalesce("class", "id")).alias("class_id"))


def drop_near(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs, with all its columns, one document of each class: the one of the least doc_id (of rows of that
    doc_id, one with the least text)."""
    own, at = unused(docs, "id"), unused(docs, "row")
    classes = near_duplicates(docs, least)
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(own)).distinct()
    out = docs.withColumn(own, F.coalesce("doc_id", F.lit(NO_ID))).join(kept, own)
    again = documents(docs, "doc_id").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if again:
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        out = out.groupBy(own).agg(F.min_by(rest, F.col("text")).alias(at)).select(f"{at}.*")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
