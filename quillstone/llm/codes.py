"""Operator 11: vectors as short codes of product quantisation, with entries found by exponion search.

A vector's integers are cut into PARTS equal parts, each with a codebook of its own. A part looks for its nearest entry
from the entry it had before: all entries that can be as near lie within twice its distance to that one, so only
the beginning of that entry's list of other entries, sorted by distance, is scanned. Everything is whole numbers:
squared distances, radii and sums are exact, ties go to the lower index.

Rounds read a table of integers and codes and write the next; nothing of a vector is shuffled. Tasks add up their parts by
entry, and these sums are all that is gathered: as many as the codebooks have numbers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SMALL_ROWS, dropped, spread, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that are compared with the same entries at once.
GROUP = 256
_LONG = (1 << 63) - 1
#: What integers are cut off at, so that they fit a long; only components beyond 4e15 get there.
_FAR = 1 << 62


class Book:
    """The entries of one part position, each with the others sorted by their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.squares = (entries * entries).sum(axis=1)
        gaps = self.squares[:, None] + self.squares[None, :] - 2 * (entries @ entries.T)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.scanned = 0

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each part's nearest entry and its squared distance; start: an entry of each part."""
        own = x - self.entries[start]
        radius = 4 * (own * own).sum(axis=1)  # twice the distance, squared
        squares = (x * x).sum(axis=1)
        index, error = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
        rows = np.argsort(start, kind="stable")
        for group in np.split(rows, np.flatnonzero(np.diff(start[rows])) + 1) if len(rows) else []:
            a = start[group[0]]
            within = np.searchsorted(self.gaps[a], radius[group], side="right")
            group, within = group[order := np.argsort(within, kind="stable")], within[order]
            for k in range(0, len(group), GROUP):
                some = group[k : k + GROUP]
                near = self.order[a, : within[min(k + GROUP, len(group)) - 1]]
                d = squares[some, None] + self.squares[near][None, :] - 2 * (x[some] @ self.entries[near].T)
                error[some] = least = d.min(axis=1)
                index[some] = np.where(d == least[:, None], near[None, :], len(self.entries)).min(axis=1)
                self.scanned += d.size
        return index, error


@dataclass
class Codebooks:
    """entries: by part, entry, position; top: the largest integer, its sign apart, of the vectors they are made for."""

    entries: list[list[list[int]]]
    width: int
    top: int

    def kind(self):
        """A type of numpy in which the distances, and four times them, are exact."""
        most = 16 * max(1, self.width) * (self.top + 1) ** 2
        return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object

    def books(self) -> list[Book]:
        return [Book(np.array(e, object).reshape(len(e), self.width).astype(self.kind())) for e in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The integers that a code stands for."""
        return [x for part, k in zip(self.entries, bytes.fromhex(code)) for x in part[k]]


def integers(vectors: DataFrame, names: tuple[str, str, str] = ("vec_id", "embedding", "label")) -> DataFrame:
    """vec_id, label, q (floor(SCALE * x) of each component) of vectors that are whole: neither null nor with a
    component that is null or not finite."""
    vec_id, vector, label = (F.col(f"`{n}`") for n in names)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    whole = vector.isNotNull() & ~F.exists(vector, lambda x: odd(x.cast("double")))
    far = F.lit(_FAR)
    floor = lambda x: F.greatest(-far, F.least(far, F.floor(x.cast("double") * SCALE)))
    return vectors.filter(whole).select(vec_id.alias("vec_id"), label.alias("label"), F.transform(vector, floor).alias("q"))


def _matrix(lists: pa.ListArray, width: int, kind) -> np.ndarray:
    """A row for each vector, PARTS times width numbers; short ones end in zeros."""
    ends = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    if len(sizes) and (sizes == PARTS * width).all():
        return flat.reshape(len(sizes), -1).astype(kind)
    out = np.zeros((len(sizes), PARTS * width), np.int64)
    out[np.arange(PARTS * width)[None, :] < sizes[:, None]] = flat
    return out.astype(kind)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)


def assigned(table: DataFrame, books: Codebooks, last: bool = False) -> DataFrame:
    """table (vec_id, label, q, code) with new codes; the last time code in hex and the error in place of q."""
    held, names = table.sparkSession.sparkContext.broadcast(books), table.columns
    width, kind = books.width, books.kind()

    def run(batches):
        own = held.value.books()
        for b in batches:
            x, start = _matrix(b.column(2), width, kind), _codes(b.column(3))
            found = [book.nearest(x[:, k * width : (k + 1) * width], start[:, k]) for k, book in enumerate(own)]
            code = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            code = [r.tobytes() for r in code]
            if last:
                error = [min(int(sum(e)), _LONG) for e in zip(*(e.tolist() for _, e in found))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.hex() for c in code], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(code, pa.binary())], names=names)

    shape = T.StructType([table.schema["vec_id"], table.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]) if last else table.schema
    return table.mapInArrow(run, shape)


def _sums(table: DataFrame, width: int, top: int, entries: int) -> DataFrame:
    """part, entry, place (-1: how many), s of all parts; a task's sums are one row each."""
    kind = np.int64 if top < 1 << 31 else object

    def run(batches):
        n, sums = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), kind)
        for b in batches:
            x, code = _matrix(b.column(0), width, kind), _codes(b.column(1))
            for k in range(PARTS):
                n[k] += np.bincount(code[:, k], minlength=entries)
                part = x[:, k * width : (k + 1) * width]
                if kind is object:
                    np.add.at(sums[k], code[:, k], part)
                else:  # sums of a batch are exact as floats
                    sums[k] += np.stack([np.bincount(code[:, k], part[:, j], entries) for j in range(width)], axis=1).astype(np.int64) if width else 0
        both = np.concatenate([n[:, :, None].astype(kind), sums], axis=2)
        part, entry, place = np.nonzero(np.broadcast_to(n[:, :, None] > 0, both.shape))
        whole = pa.array(both[part, entry, place].tolist(), pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32) - 1), whole], names=["part", "entry", "place", "s"])

    out = table.select("q", "code").mapInArrow(run, "part int, entry int, place int, s decimal(38, 0)")
    return out.groupBy("part", "entry", "place").agg(F.sum("s").alias("s"))


def trained(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """(codebooks after so many rounds, rows with their codes in the last); rows: as integers() gives them."""
    table = written(spread(rows).withColumn("code", F.lit(bytes(PARTS))))
    found = table.agg(F.max(F.size("q")).alias("size"), F.max(F.array_max(F.transform("q", F.abs))).alias("top")).first()
    width, top = -(-max(0, found["size"] or 0) // PARTS), found["top"] or 0
    seeds = [r["q"] for r in table.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(min(entries, 256)).select("q").collect()]
    seeds = [q + [0] * (PARTS * width - len(q)) for q in seeds]
    books = Codebooks([[q[k * width : (k + 1) * width] for q in seeds] for k in range(PARTS)], width, top)
    for _ in range(rounds if seeds else 0):
        new = written(assigned(table, books))
        dropped(table)
        table = new
        sums = {(r["part"], r["entry"], r["place"]): int(r["s"]) for r in _sums(table, width, top, len(seeds)).collect()}
        mean = lambda k, e, old: [sums[k, e, j] // sums[k, e, -1] for j in range(width)] if (k, e, -1) in sums else old
        books = Codebooks([[mean(k, e, old) for e, old in enumerate(part)] for k, part in enumerate(books.entries)], width, top)
    return books, table


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error (the parts' squared distances), label_error (summed over rows of the
    label), codebooks_sha256 of each whole vector of vectors (vec_id, embedding, label).

    Vectors that are null or hold a null or a component that isn't finite go. Codebooks start as the least vec_ids; rows that
    share one, or have none (these come last), go by their integers. Fewer vectors than entries make as many entries.
    Vectors shorter than the longest end in zeros, as do those whose length PARTS doesn't divide; empty ones are whole. Null
    labels are one label. Integers beyond 2^62, errors and their sums beyond a long are cut off there. An empty table gives an
    empty one; other columns are ignored.
    """
    books, table = trained(integers(vectors), entries, rounds)
    out = written(assigned(table, books, last=True))
    dropped(table)
    whole = F.least(F.sum(F.col("error").cast("decimal(38, 0)")), F.lit(_LONG).cast("decimal(38, 0)")).cast("long")
    sums = out.groupBy(F.col("label").alias("__label")).agg(whole.alias("label_error"))
    if sums.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        sums = F.broadcast(sums)
    out = out.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    w = f"(SELECT max(len(embedding)) // {PARTS} FROM embeddings)"
    sql = [
        "c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE embedding IS NOT NULL)",
        "bad AS (SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x))",
        f"q AS MATERIALIZED (SELECT vec_id, i // {w} AS part, i % {w} AS place, floor(x * {SCALE}) AS x FROM c WHERE vec_id NOT IN (SELECT vec_id FROM bad))",
        "p AS MATERIALIZED (SELECT vec_id, part, list(x ORDER BY place) AS x FROM q GROUP BY ALL)",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        distance = "(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x))::BIGINT"
        sql.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, min({distance} * 256 + entry) AS pair FROM p JOIN b{k} b USING (part) GROUP BY ALL)")
        if k < ROUNDS:
            sql.append(f"s{k} AS (SELECT part, pair % 256 AS entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN q USING (vec_id, part) GROUP BY ALL)")
            sql.append(f"n{k} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY place) AS x FROM s{k} GROUP BY ALL)")
            sql.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN n{k} n USING (part, entry))")
    sql += [
        f"h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS x, unnest(range(len(x))) AS i FROM b{ROUNDS}))",
        f"r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(pair % 256)), 2, '0'), '' ORDER BY part) AS code, sum(pair // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)",
    ]
    return "WITH " + ",\n".join(sql) + "\nSELECT r.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN embeddings USING (vec_id), h"


ORACLE = _oracle()
