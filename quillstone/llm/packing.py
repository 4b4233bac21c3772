"""Operator 1: packing of token sequences into windows with minimum bin slack.

Blocks of documents (what one task reads, cut at BLOCK_TOKENS) are packed on their own, so nothing is
shuffled and no group grows with the input. In a block a document gives whole windows and a remainder.
Remainders are known by their length only: a bitset subset-sum dynamic programme looks for the multiset
of remaining lengths that, with the longest one left, fills a window closest to its capacity; counts are
backtracked from the bitsets and the pattern is used as often as the counts allow. A length that no
multiset completes exactly can't be completed later either, as counts only fall: its pieces are laid end
to end and cut at the window's end, and what is left last is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import id_cache, words_of
from .shared import documents, spread

#: Tokens of documents that are packed together; a bound of a task's memory.
BLOCK_TOKENS = 4_000_000


def fill(gap: int, counts: dict[int, int], lengths: list[int]) -> tuple[int, dict[int, int]]:
    """The largest sum up to gap of lengths, each used at most counts[length] times, and the counts used.

    lengths: descending. Bit s of `reach` is set if sum s can be made of the lengths seen so far.
    """
    reach, full, steps = 1, 1 << gap, []
    for n in lengths:
        if n > gap:
            continue
        most, take = min(counts.get(n, 0), gap // n), 1
        while most > 0:  # 1, 2, 4, ... copies make every number of copies up to the count
            take = min(take, most)
            steps.append((n, take, reach))
            reach |= (reach << n * take) & (2 * full - 1)
            most, take = most - take, 2 * take
        if reach & full:
            break
    best = at = reach.bit_length() - 1
    used: Counter = Counter()
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            used[n] += take
    return best, dict(used)


def windows(lengths: Counter, capacity: int) -> Iterator[tuple[dict[int, int], int] | None]:
    """(counts of lengths in a window, how many such windows), each exactly full; lengths that are left
    over can't fill a window exactly."""
    counts = {n: c for n, c in lengths.items() if c and n > 0}
    order = sorted(counts, reverse=True)
    for seed in order:
        while counts[seed]:
            counts[seed] -= 1
            best, used = fill(capacity - seed, counts, order)
            counts[seed] += 1
            if best != capacity - seed:
                break
            used[seed] = used.get(seed, 0) + 1
            times = min(counts[n] // k for n, k in used.items())
            for n, k in used.items():
                counts[n] -= k * times
            yield used, times


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; capacity: a power of two.

    Every token lies in exactly one piece, every sequence is full or has a power of two of tokens.
    """
    out, sequence, by_length = [], 0, {}
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            by_length.setdefault(n % capacity, deque()).append((d, n - n % capacity))
    for used, times in windows(Counter({n: len(q) for n, q in by_length.items()}), capacity):
        for _ in range(times):
            at = 0
            for n, k in sorted(used.items(), reverse=True):
                for _ in range(k):
                    d, start = by_length[n].popleft()
                    out.append((d, start, n, sequence, at))
                    at += n
            sequence += 1
    rest = [(d, start, n) for n in sorted(by_length, reverse=True) for d, start in by_length[n]]
    total, room, at = sum(n for _, _, n in rest), 0, 0
    for d, start, n in rest:
        while n:
            if at == room:
                room, at = min(capacity, 1 << total.bit_length() - 1), 0
                total -= room
                sequence += 1
            k = min(n, room - at)
            out.append((d, start, k, sequence - 1, at))
            start, n, at = start + k, n - k, at + k
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each piece of every document of docs (SCHEMA).

    Null and empty texts are the end id alone. Each row of docs is a document, also if its doc_id is null
    or comes again. Sequence numbers are unique over the whole result. Other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        split, get = words_of(tokenizer_path).split, id_cache(tokenizer_path).__getitem__
        part, first = TaskContext.get().partitionId() << 33, 0
        ids: list = []
        held: list[bytes] = []
        size = 0

        def packed():
            nonlocal first
            rows = pack([len(h) // 4 for h in held], capacity)
            for k in range(0, len(rows), 100_000):
                d, start, length, seq, offset = zip(*rows[k : k + 100_000])
                crc = [zlib.crc32(memoryview(held[a])[4 * b : 4 * (b + c)]) for a, b, c in zip(d, start, length)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in ([ids[a] for a in d], start, length, crc, [len(held[a]) // 4 for a in d], np.array(seq) + (part + first), offset)],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )
            first += 1 + max((r[3] for r in rows), default=-1)
            ids.clear()
            held.clear()

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                held.append(b"".join(map(get, split(t))) + end)
                size += len(held[-1]) // 4
                if size >= block_tokens:
                    yield from packed()
                    size = 0
        if ids:
            yield from packed()

    return spread(documents(docs)).mapInArrow(run, SCHEMA)
