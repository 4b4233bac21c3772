"""Operator 8: document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold the polynomial hash of each of its beginnings, modulo a prime and for two
bases. Two lookups give the hash of any span, so equal spans are told in constant time, and the longest
common extension of two places by binary search. The fingerprint is the SIZE smallest of the mixed hashes
of all spans of one width; the likeness of two fingerprints estimates the Jaccard likeness of the texts'
sets of spans, and is exact for short ones. It also holds those of the narrower width, as texts of different
lengths are compared at the width of the shorter one. Spans of that width also reach over a text's ends, where marks
stand for what isn't there: so the shortest texts have spans, too, and their order and length tell.

A document's edited text needs the next document in the order of doc_id. Documents are dealt once, by
ranges of doc_id with counted bounds, and sorted there; the first of a range also goes to the range before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, portions, spread

#: Widths of spans, and the code points from which each is a text's own.
WIDTHS = {24: 96, 6: 0}
NARROW = 6
#: What stands before and behind a text: no code points.
START, END = 0x110000, 0x110001
#: Smallest hashes of a width that a fingerprint holds, and bits of each: texts of ten million code points
#: have an equal hash by chance with probability 2e-6.
SIZE, BITS = 64, 48
DIGITS = BITS // 4
PRIME = (1 << 31) - 1
BASES = (918_273_647, 1_537_228_673)
_PORTION = 1 << 20
#: Bytes of text that a task compares, about.
RANGE_BYTES = 64_000_000
#: Rows that are Python's strings at a time.
PORTION_ROWS = 500
#: A null doc_id comes before all others.
NO_ID = -(1 << 63)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for uint64 below 2^63."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


class _Powers:
    """Powers of a base and of its inverse, as many as the longest text so far needs."""

    def __init__(self, base: int):
        self.steps = base, pow(base, -1, PRIME)
        self.tables = [np.ones(1, np.uint32) for _ in self.steps]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k, step in enumerate(self.steps):
            t = self.tables[k]
            while len(t) < n:  # doubled: the second half is the first one times a power
                t = np.concatenate([t, _fold(t.astype(np.uint64) * np.uint64(pow(step, len(t), PRIME))).astype(np.uint32)])
            self.tables[k] = t
        return self.tables[0], self.tables[1]


_powers = tuple(map(_Powers, BASES))


class Prefixes:
    """The prefix arrays of a text (code points as 32-bit numbers)."""

    def __init__(self, codes: np.ndarray, head: Prefixes | None = None, kept: int = 0):
        """The first `kept` code points are those of `head`, whose arrays are taken over."""
        self.n, self.arrays = len(codes), []
        for k, powers in enumerate(_powers):
            up, _ = powers.upto(self.n + 1)
            out = np.empty(self.n + 1, np.uint32)
            out[0] = 0
            if head:
                out[: kept + 1] = head.arrays[k][: kept + 1]
            for a in range(kept, self.n, _PORTION):
                b = min(a + _PORTION, self.n)
                terms = (codes[a:b].astype(np.uint64) + np.uint64(1)) * up[a:b]
                terms = (terms & np.uint64(PRIME)) + (terms >> np.uint64(31))  # below 2^32: the sums fit
                out[a + 1 : b + 1] = _fold(np.cumsum(terms) + np.uint64(out[a]))
            self.arrays.append(out)

    def windows(self, a: int, b: int, width: int) -> np.ndarray:
        """The hashes of the spans of `width` that start at a, a + 1, ... b - 1, 62 bits each."""
        out = np.zeros(max(0, b - a), np.uint64)
        for powers, prefix in zip(_powers, self.arrays):
            _, down = powers.upto(self.n + 1)
            d = prefix[a + width : b + width].astype(np.uint64) + np.uint64(PRIME) - prefix[a:b]  # below 2^32
            out = (out << np.uint64(31)) | _fold(d * down[a:b])
        return out

    def span(self, a: int, b: int) -> tuple[int, ...]:
        """The hash of one span, for both bases."""
        downs = (powers.upto(self.n + 1)[1] for powers in _powers)
        return tuple((int(x[b]) - int(x[a])) * int(down[a]) % PRIME for x, down in zip(self.arrays, downs))


def common_extension(x: Prefixes, i: int, y: Prefixes, j: int) -> int:
    """How many code points from place i of x and place j of y on are equal, by binary search."""
    low, high = 0, min(x.n - i, y.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x.span(i, i + mid) == y.span(j, j + mid) else (low, mid - 1)
    return low


def width_of(n: int) -> int:
    """The span width by the text's length: short texts have few spans."""
    return next(w for w, least in WIDTHS.items() if n >= least)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - BITS)


def _least(values: list[np.ndarray], size: int) -> np.ndarray:
    """The smallest distinct values."""
    x = np.concatenate(values) if values else np.empty(0, np.uint64)
    if len(x) > 4 * size:
        least = np.unique(np.partition(x, 4 * size)[: 4 * size])
        if len(least) > size:  # none that was left out is smaller than these
            return least[:size]
    return np.unique(x)[:size]


def mixed(p: Prefixes, a: int, b: int, width: int) -> np.ndarray:
    """Mixed hashes of the spans of `width` that start in [a, b)."""
    parts = [_mix(p.windows(k, min(k + _PORTION, b), width)) for k in range(a, b, _PORTION)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint64), *parts])


_first_powers = tuple([pow(base, k, PRIME) for k in range(NARROW)] for base in BASES)


def edges(codes: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans of NARROW that reach over a text's ends; of a text shorter than that, all that it has."""
    k = NARROW - 1
    if len(codes) < NARROW:
        parts = [[START] * k + codes.tolist() + [END] * k]
    else:
        parts = [[START] * k + codes[:k].tolist(), codes[-k:].tolist() + [END] * k]
    out = []
    for x in parts:
        x = [c + 1 for c in x]
        for a in range(len(x) - k):
            one, two = (sum(c * p for c, p in zip(x[a : a + NARROW], powers)) % PRIME for powers in _first_powers)
            out.append(one << 31 | two)
    return _mix(np.array(out, np.uint64))


class Print:
    """A text's prefix arrays, mixed span hashes and fingerprint."""

    def __init__(self, text: str, head: Print | None = None, kept: int = 0, size: int = SIZE):
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        self.n, self.width = len(codes), width_of(len(codes))
        self.prefixes = Prefixes(codes, head.prefixes if head else None, kept)
        self.hashes, self.least = {}, {}
        for width in (w for w in WIDTHS if w <= self.width):
            last = max(0, self.n - width + 1)
            same = min(last, max(0, kept - width + 1)) if head and width in head.hashes else 0
            own = mixed(self.prefixes, same, last, width)
            self.hashes[width] = np.concatenate([head.hashes[width][:same], own]) if same else own
            self.least[width] = _least([self.hashes[width], *([edges(codes)] if width == NARROW else [])], size)

    @property
    def text(self) -> str:
        """The fingerprint: of the text's own width and then of each narrower one, separated by commas, the
        width and the smallest hashes in order, all in hexadecimal."""
        return ",".join(f"{w:02x}" + (x << np.uint64(64 - BITS)).astype(">u8").view("u1").reshape(-1, 8)[:, : BITS // 8].tobytes().hex() for w, x in self.least.items())


def likeness(a: str, b: str, size: int = SIZE) -> float:
    """Of two fingerprints, from 0 to 1, at the lesser of their own widths. Those of empty texts are alike."""
    if a == b:
        return 1.0
    width = min(a[:2], b[:2])
    x, y = (next(p for p in t.split(",") if p[:2] == width) for t in (a, b))
    x, y = ({t[k : k + DIGITS] for k in range(2, len(t), DIGITS)} for t in (x, y))
    both = sorted(x | y)[:size]
    return sum(h in x and h in y for h in both) / len(both) if both else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row; null text: empty. Equal texts, equal fingerprints."""

    def run(batches):
        for b in batches:
            found = [Print(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_chars": pa.array([x.n for x in found], pa.int64()), "fingerprint": pa.array([x.text for x in found], pa.string())})

    return spread(documents(docs)).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """r, extra, id, doc_id, text in ranges r of id; rows of extra 1 are the first of the next range.

    The ids' quantiles cut many narrow ranges, whose texts' bytes are counted; neighbours are joined to ranges of
    about equal bytes, RANGE_BYTES at most unless the shuffle partitions ask for smaller ones.
    """
    spark = docs.sparkSession
    ids = documents(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def quantiles(n: int):
        narrow = 8 * n
        at = F.percentile_approx("id", [k / narrow for k in range(1, narrow)], max(10_000, 4 * narrow))
        total, found = ids.agg(F.sum("bytes"), at).first()
        return total or 0, np.array(sorted(set(found or [])), np.int64)

    total, cuts = quantiles(n)
    if total > n * RANGE_BYTES:
        n = -(-total // RANGE_BYTES)
        total, cuts = quantiles(n)

    def first_of(batches):
        least: dict[int, list[int]] = {}
        for b in batches:
            x, size = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for r in np.unique(at := np.searchsorted(cuts, x, side="right")):
                own, low = at == r, least.setdefault(int(r), [1 << 62, 0])
                low[:] = min(low[0], int(x[own].min())), low[1] + int(size[own].sum())
        yield pa.RecordBatch.from_pydict({"r": pa.array(list(least), pa.int32()), "id": pa.array([x[0] for x in least.values()], pa.int64()), "bytes": pa.array([x[1] for x in least.values()], pa.int64())})

    held = sorted(map(tuple, ids.mapInArrow(first_of, "r int, id long, bytes long").groupBy("r").agg(F.min("id").alias("id"), F.sum("bytes").alias("bytes")).collect()))
    found, done = [], 0
    for _, i, size in held:
        r = min(n - 1, done * n // max(1, total))
        if not found or found[-1][0] != r:
            found.append((r, i))
        done += size
    cuts = np.array([i for _, i in found[1:]], np.int64)
    found = [(k, i) for k, (_, i) in enumerate(found)]
    before = {i: found[k - 1][0] for k, (_, i) in enumerate(found)}  # the last range is before the first one
    firsts = pa.array(list(before), pa.int64())

    def deal(batches):
        import pyarrow.compute as pc

        for b in batches:
            own = pa.array(np.searchsorted(cuts, b.column("id").to_numpy(zero_copy_only=False), side="right"), pa.int32())
            yield pa.RecordBatch.from_arrays([own, pa.array(np.zeros(b.num_rows), pa.int32()), *b.columns], names=["r", "extra", *b.schema.names])
            more = b.filter(pc.is_in(b.column("id"), firsts))
            if more.num_rows:
                to = pa.array([before[i] for i in more.column("id").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(more.num_rows), pa.int32()), *more.columns], names=["r", "extra", *b.schema.names])

    src = spread(documents(docs)).withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).select("id", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(deal, "r int, extra int, id long, doc_id long, text string"), n


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    common_prefix (code points that the text and the edited one share from the start).

    The edited text: the last floor(n_chars / 4) code points are replaced by as many (or all) of the first
    of the next document in the order of doc_id, null first and then by text; the last one's next is the
    first. Null texts are empty. Each row is a document; other columns are ignored.
    """
    dealt, n = with_next(docs)

    def run(batches):
        group, held, own = None, None, None  # the row that waits for its next one
        for b in portions(batches, PORTION_ROWS):
            out = []
            for r, extra, i, text in zip(*(b.column(c).to_pylist() for c in ("r", "extra", "doc_id", "text"))):
                if r != group:
                    group, held = r, None
                elif held is None:
                    continue  # further rows of the next range's first doc_id
                p = Print(text)
                if held is not None:
                    cut = own.n // 4
                    new = held[1][: own.n - cut] + text[:cut]
                    edited = Print(new, own, own.n - cut)
                    a, e = own.text, edited.text
                    out.append((held[0], own.n, hashlib.sha256(new.encode()).hexdigest(), a, e, likeness(a, e), likeness(a, p.text), common_extension(own.prefixes, 0, edited.prefixes, 0)))
                held, own = (None, None) if extra else ((i, text), p)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], names=names)

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    names = [x.split()[0] for x in shape.split(", ")]
    return dealt.repartitionById(n, F.col("r")).sortWithinPartitions("r", "extra", "id", "text").mapInArrow(run, shape)


#: DuckDB's form of the edited texts and of how far they agree with the texts, over the view documents.
ORACLE_EDITED = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (
  SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u, CAST(floor(length(t) / 4) AS BIGINT) AS cut FROM d
)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, CAST(length(t) - cut AS BIGINT)) || left(u, cut)) AS edited_sha256 FROM n
"""
