"""64-bit hashes of words and of numbers, in numpy."""
from __future__ import annotations

import numpy as np

ODD, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x + np.uint64(ODD)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BYTES = mix(np.arange(256, dtype=np.uint64))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for rolling hashes of words."""
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 19)
        for k, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def word_hashes(parts: list[bytes], space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each part and the end); words are maximal runs of bytes that space (256 booleans, 0x20 among them) doesn't mark."""
    size = sum(map(len, parts)) + len(parts) + 1
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    starts_of = np.cumsum([1, *(len(p) + 1 for p in parts)])
    power, inverse = _powers(size + 1)
    upto = np.cumsum(_BYTES[data] * power[: len(data)])
    black = ~space[data]
    edge = np.flatnonzero(black[1:] != black[:-1])  # words lie between edges 0-1, 2-3, ...
    first, last = edge[0::2], edge[1::2]
    word = mix((upto[last] - upto[first]) * inverse[first + 1] + (last - first).astype(np.uint64))
    return word, np.searchsorted(first + 1, starts_of)
