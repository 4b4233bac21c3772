"""Operator 3: byte-level BPE over a table of distinct words, and decoding through a join with the pieces.

The pre-tokenizer's words are split from each block of documents; a block is what one task has read, cut
at BLOCK_CHARS. Each block ranks its distinct words. Words of all blocks meet in buckets by a hash of the
word, where each distinct word is encoded once as the lists stream by; the ids go back to the block, and there the documents,
held as ranks, take them by position. Only compressed lists of distinct words and of ranks are shuffled,
never text.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .shared import documents, spread, written

#: Code points of text after which a block ends.
BLOCK_CHARS = 12_000_000

# Fixed value: the pattern by which the tokenizer's pre-tokenizer splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_any = regex.compile(PATTERN)
_ascii = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Words:
    """Splits texts into the words that a tokenizer file's BPE works on; added tokens are words too."""

    def __init__(self, path: str):
        added = json.load(open(path, encoding="utf-8"))["added_tokens"]
        self.added = re.compile("(" + "|".join(re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"]))) + ")") if added else None

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.added and self.added.search(text):
            out: list[str] = []
            for k, part in enumerate(self.added.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        return (_ascii if text.isascii() else _any).findall(text)


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(2)
def words_of(path: str) -> Words:
    return Words(path)


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for
    themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_encoder(path: str):
    """Ids of one word by the tokenizer's merges alone, as it was split from its text already."""
    t, table = tokenizer(path), _byte_characters()
    merge = t.model.tokenize
    added = {x.content: [i] for i, x in t.get_added_tokens_decoder().items()}
    return lambda word: added.get(word) or [x.id for x in merge(word.encode().decode("latin-1").translate(table))]


class IdCache(dict):
    """Word to its ids as little-endian unsigned 32-bit integers; emptied when it holds `most` words."""

    def __init__(self, path: str, most: int = 700_000):
        self.encode, self.most = word_encoder(path), most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = array("I", self.encode(word)).tobytes()
        return out


@lru_cache(1)
def id_cache(path: str) -> IdCache:
    """One for all tasks of a worker."""
    return IdCache(path)


def pieces(path: str) -> list[bytes]:
    """The bytes of each id, as the byte-level decoder gives them; size bound: the vocabulary."""
    t, byte = tokenizer(path), {c: b for b, c in _byte_characters().items()}
    out = []
    for i in range(t.get_vocab_size(with_added_tokens=True)):
        token = t.id_to_token(i) or ""
        out.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
    return out


class Ragged:
    """Rows of unequal length in one flat array; take() concatenates rows by number."""

    def __init__(self, rows: list[bytes], dtype: str):
        self.flat = np.frombuffer(b"".join(rows), dtype)
        self.lens = np.fromiter(map(len, rows), np.int64, len(rows)) // self.flat.itemsize
        self.starts = np.cumsum(self.lens) - self.lens

    def take(self, rows: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """Row numbers in portions, so that the index arrays stay small."""
        out = []
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            n = self.lens[r]
            shift = self.starts[r] - (np.cumsum(n) - n)
            out.append(self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))])
        return np.concatenate(out) if out else self.flat[:0]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list, list[str]]]:
    """(block, doc ids, texts): what the task reads, cut by text size."""
    part, k, ids, texts, chars = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or "")
            chars += len(texts[-1])
            if chars >= limit:
                yield f"{part}-{k}", ids, texts
                k, ids, texts, chars = k + 1, [], [], 0
    if ids:
        yield f"{part}-{k}", ids, texts


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def _ranked(texts: list[str], split) -> list[str]:
    """Distinct words, frequent ones first, so that their numbers are small."""
    found: Counter = Counter()
    for t in texts:
        found.update(split(t))
    return [w for w, _ in found.most_common()]


def _planes(numbers: np.ndarray) -> bytes:
    """Compressed: all low bytes, then the second ones and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), 1)


def _numbers(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(held), "u1").reshape(4, -1).T).view("<u4").ravel()


def _dictionary(path: str, limit: int, buckets: int):
    """A row for each block and bucket: the block's words of that bucket, in rank order."""

    def run(batches):
        split = words_of(path).split
        for block, _, texts in _blocks(batches, limit):
            parts: list[list[str]] = [[] for _ in range(buckets)]
            for w in _ranked(texts, split):
                parts[_bucket(w, buckets)].append(w)
            rows = [(k, zstandard.compress(b"".join(b"%d " % len(x) + x for x in map(str.encode, p)), 1)) for k, p in enumerate(parts) if p]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(rows), pa.string()), "bucket": pa.array([x[0] for x in rows], pa.int32()), "words": pa.array([x[1] for x in rows], pa.binary())})

    return run


def _positions(path: str, limit: int, buckets: int):
    """A row for each block: its documents as ranks of words, and the bucket of each rank."""

    def run(batches):
        split = words_of(path).split
        for block, ids, texts in _blocks(batches, limit):
            ranked = _ranked(texts, split)
            rank = {w: k for k, w in enumerate(ranked)}.__getitem__
            codes = [array("I", map(rank, split(t))) for t in texts]
            where = np.array([_bucket(w, buckets) for w in ranked], "<u4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.string()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(c) for c in codes]], pa.list_(pa.int64())), pa.array([_planes(where)], pa.binary()), pa.array([_planes(np.frombuffer(b"".join(c.tobytes() for c in codes), "<u4"))], pa.binary())],
                names=["block", "doc_ids", "counts", "buckets", "codes"],
            )

    return run


def _unpacked(held: bytes) -> Iterator[bytes]:
    b, at = zstandard.decompress(held), 0
    while at < len(b):
        space = b.index(b" ", at)
        end = space + 1 + int(b[at:space])
        yield b[space + 1 : end]
        at = end


def _encode_once(path: str):
    """Words of one bucket, block after block: each distinct word is encoded once. What a task holds is a
    bucket's distinct words, not the blocks' lists."""

    def run(batches):
        encode, at, known = word_encoder(path), None, {}
        for batch in batches:
            out = []
            for block, bucket, held in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "words"))):
                if bucket != at:
                    at, known = bucket, {}
                ids = []
                for w in _unpacked(held):
                    own = known.get(w)
                    if own is None:
                        own = known[w] = encode(w.decode())
                    ids.append(own)
                out.append((_planes(np.fromiter(map(len, ids), np.uint32, len(ids))), _planes(np.fromiter(chain.from_iterable(ids), np.uint32))))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["block", "bucket", "lens", "ids"])

    return run


#: Partitions of the input for each bucket, at most.
BUCKET_PARTITIONS = 64


def _steady(docs: DataFrame) -> DataFrame:
    """docs if it is a table, its columns and filters, which any read gives alike; else written as a table, as
    a block's words are told apart by the place where its documents are read."""
    lines = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    plain = all(re.match(r"[\s:+\-]*(Project|Filter|Relation|LocalRelation)\b", x) for x in lines if x.strip())
    return docs if plain else written(docs)


def encode(docs: DataFrame, tokenizer_path: str, finish=None, schema: str = "doc_id long, ids binary", block_chars: int = BLOCK_CHARS, buckets: int | None = None) -> DataFrame:
    """A row for each document: doc_id, ids (little-endian unsigned 32-bit integers, whole text).

    Null and empty texts have no ids; equal rows and equal or null doc_ids give a row each; other columns
    of docs are ignored. finish(doc ids, list of id arrays) -> dict of columns replaces the ids by what is
    derived from them in the same task. buckets: parts of the word table; by default as many as shuffle
    partitions, 64 at least, and one for each BUCKET_PARTITIONS of the input.
    """
    docs = _steady(documents(docs))
    buckets = buckets or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions() // BUCKET_PARTITIONS)
    src = spread(docs)
    words = src.mapInArrow(_dictionary(tokenizer_path, block_chars, buckets), "block string, bucket int, words binary")
    words = words.repartition("bucket").sortWithinPartitions("bucket")
    known = words.mapInArrow(_encode_once(tokenizer_path), "block string, bucket int, lens binary, ids binary")
    held = src.mapInArrow(_positions(tokenizer_path, block_chars, buckets), "block string, doc_ids array<long>, counts array<long>, buckets binary, codes binary")
    finish = finish or (lambda ids, arrays: {"doc_id": pa.array(ids, pa.int64()), "ids": pa.array([a.tobytes() for a in arrays], pa.binary())})

    def meet(table: pa.Table, held: pa.Table) -> pa.Table:
        where = _numbers(held.column("buckets")[0].as_py())
        rows, lens = [np.empty(0, "<u4")] * buckets, np.zeros(len(where), np.int64)
        for k, n, ids in zip(*(table.column(c).to_pylist() for c in ("bucket", "lens", "ids"))):
            n, at = _numbers(n), where == k
            if int(at.sum()) != len(n):
                raise RuntimeError("the words of a block changed between two reads of the input")
            lens[at], rows[k] = n, _numbers(ids)
        order = np.argsort(where, kind="stable")  # ranks in the order in which their ids lie in rows
        ragged = Ragged([], "<u4")
        ragged.flat, ragged.lens, ragged.starts = np.concatenate(rows), lens, np.empty(len(where), np.int64)
        ragged.starts[order] = np.cumsum(lens[order]) - lens[order]
        codes, ends = _numbers(held.column("codes")[0].as_py()), np.cumsum(held.column("counts")[0].as_py())
        out = []
        for k in range(0, len(ends), 500):
            starts = [0 if j == 0 else ends[j - 1] for j in range(k, min(k + 500, len(ends)))]
            arrays = [ragged.take(codes[a:b]) for a, b in zip(starts, ends[k : k + 500])]
            out.append(pa.Table.from_pydict(finish(held.column("doc_ids")[0].as_py()[k : k + 500], arrays)))
        return pa.concat_tables(out)

    return known.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(meet, schema)


class Decoder:
    """Ids to texts: the distinct ids of a batch are joined with the table of pieces, which has a row for each
    entry of the vocabulary; the pieces' bytes are put back by position and read as UTF-8."""

    def __init__(self, path: str):
        held = pieces(path)
        self.pieces = pa.table({"id": pa.array(range(len(held)), pa.int64()), "piece": pa.array(held, pa.binary())})

    def texts(self, arrays: list[np.ndarray]) -> list[str]:
        there = np.bincount(np.concatenate([np.empty(0, np.int64), *arrays]).astype(np.int64)) > 0
        found = pa.table({"id": pa.array(np.flatnonzero(there), pa.int64())}).join(self.pieces, "id", join_type="left outer", use_threads=False).sort_by("id")
        rows, number = Ragged([x or b"" for x in found.column("piece").to_pylist()], "u1"), np.cumsum(there) - 1
        return [rows.take(number[a]).tobytes().decode("utf-8", "replace") for a in arrays]


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text for rows of doc_id, ids (as encode() gives them). Null ids: empty text."""

    def run(batches):
        d = decoder(tokenizer_path)
        for b in batches:
            text = d.texts([np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(text, pa.string())})

    return documents(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (see encode() for odd rows)."""

    def digests(ids, arrays):
        d = decoder(tokenizer_path)
        return {
            "doc_id": pa.array(ids, pa.int64()),
            "n_tokens": pa.array(map(len, arrays), pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(a.tobytes()).hexdigest() for a in arrays], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in d.texts(arrays)], pa.string()),
        }

    return encode(docs, tokenizer_path, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", block_chars)
