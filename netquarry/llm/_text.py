"""Vectorised byte-level text kernels: words, word hashes and word windows of whole Arrow string columns.

UTF-8 keeps every ASCII delimiter a single byte, so the word rules of the corpus operators are decided byte by byte.
A word's identity is a 64-bit polynomial hash of its lower-cased bytes, finalised by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of bytes other than ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII letters, digits and non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n``."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=U)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (the public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer text stands alone."""
    offsets = flat(column)[1]
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high
        low = high


class Words:
    """Words of a column slice: byte spans, owners and hashes.

    ``start``/``end``: byte spans; ``first[i]:first[i+1]``: the words of row i; ``hash``: 64-bit identities.
    """

    def __init__(self, column: pa.Array, rule: np.ndarray, hashes: bool = True):
        self.raw, self.offsets = flat(column)
        n = len(self.raw)
        inside = rule[self.raw]
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside
        before[self.offsets[:-1]] = False
        after = np.zeros(n + 1, dtype=bool)
        after[:-1] = inside
        after[self.offsets[1:]] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        n = len(self.raw)
        power, inverse = _tables(n)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((LOWER[self.raw].astype(U) + U(1)) * power[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every window of k words inside a row."""
        return windows(self.hash, self.first, k)

    def word(self, i: int) -> bytes:
        return LOWER[self.raw[self.start[i] : self.end[i]]].tobytes()


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    value = np.zeros(n, dtype=U)
    for j in range(k):
        value = value * _BASE + hashes[j : j + n]
    last = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + k <= last)
    return at, mix(value[at])


def hash_word(word: bytes) -> int:
    """The identity that ``Words`` gives to one word."""
    return int(Words(pa.array([word.decode("utf-8")]), np.ones(256, dtype=bool)).hash[0])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs: starts[0], starts[0]+1, ... starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
