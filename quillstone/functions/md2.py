"""The MD2 digest, for many values at once."""

from __future__ import annotations

import numpy as np


def _pi(digits: int) -> str:
    """3, and so many decimals of pi (Machin's formula in whole numbers)."""
    one = 10 ** (digits + 10)

    def arctan(x: int) -> int:
        total, term, k = 0, one // x, 1
        while term:
            total += term // k if k % 4 == 1 else -(term // k)
            term, k = term // (x * x), k + 2
        return total

    return str((16 * arctan(5) - 4 * arctan(239)) // 10**10)


def _table() -> np.ndarray:
    """The digest's permutation of the bytes: a shuffle whose random numbers are digits of pi."""
    digits = iter(map(int, _pi(900)))

    def below(n: int) -> int:
        while True:
            x, y = 0, 1
            while y < n or y == 1:
                x, y = 10 * x + next(digits), 10 * y
            if x < n * (y // n):
                return x % n

    out = list(range(256))
    for k in range(2, 257):
        j = below(k)
        out[j], out[k - 1] = out[k - 1], out[j]
    return np.array(out, np.uint8)


_S = _table()


def _sealed(value: bytes) -> bytes:
    """A value, filled up to whole blocks of 16 bytes."""
    n = 16 - len(value) % 16
    return value + bytes([n]) * n


def md2(values: list[bytes]) -> list[bytes]:
    """The digest of each value. Values go through their blocks side by side: those with more blocks go on alone."""
    blocks = [np.frombuffer(_sealed(v), np.uint8).reshape(-1, 16) for v in values]
    order = sorted(range(len(values)), key=lambda k: -len(blocks[k]))
    sizes = np.array([len(blocks[k]) for k in order], np.int64)
    state, check, last = np.zeros((48, len(order)), np.uint8), np.zeros((16, len(order)), np.uint8), np.zeros(len(order), np.uint8)

    def taken(block: np.ndarray, n: int) -> None:
        x = state[:, :n]
        x[16:32] = block
        x[32:] = x[16:32] ^ x[:16]
        t = np.zeros(n, np.uint8)
        for r in range(18):
            for k in range(48):
                x[k] ^= _S[t]
                t = x[k]
            t = t + np.uint8(r)

    for i in range(int(sizes.max(initial=0))):
        n = int((sizes > i).sum())
        block = np.stack([blocks[k][i] for k in order[:n]], axis=1)
        for j in range(16):
            check[j, :n] ^= _S[block[j] ^ last[:n]]
            last[:n] = check[j, :n]
        taken(block, n)
    taken(check, len(order))
    out: list[bytes] = [b""] * len(values)
    for k, place in enumerate(order):
        out[place] = state[:16, k].tobytes()
    return out
