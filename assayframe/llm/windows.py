"""Words of many texts as arrays: hashes, positions, and hashes of runs of words.

Words are hashed eight bytes at a time, all words of a block of texts at once, and long words by XXH64. The hash of a window of bytes
a..b is a polynomial over a fixed random table, from differences of one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

#: Texts are handled together until they have so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(1, 1 << 64, 256, dtype=np.uint64)


class _Powers:
    """Powers of the multiplier and of its inverse, as many as the longest block so far needs."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES * 2)
            factors = np.full(size, MULTIPLIER, np.uint64)
            factors[0] = 1
            cls.up = np.cumprod(factors)
            factors = np.full(size, INVERSE, np.uint64)
            factors[0] = 1
            cls.down = np.cumprod(factors)
        up, down = cls.up[:n], cls.down[:n]
        if len(cls.up) > BLOCK_BYTES * 64:
            cls.up = cls.down = np.ones(1, np.uint64)  # don't keep what one huge text needed
        return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): (sums[b] - sums[a]) * down[a] is the hash of bytes a..b-1, wherever they are."""
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_table()[data] * up[: len(data)], out=sums[1:])
    return sums, down


def blocks(texts: list[bytes], at_most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of consecutive texts that together have about at_most bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= at_most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


#: Longer words are hashed one by one.
LONG_WORD = 64


def word_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin[i]:end[i]], none of them empty."""
    size = end - begin
    out = size.astype(np.uint64) * np.uint64(MULTIPLIER)
    if not len(out):
        return out
    eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(8), np.uint8), 8)
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        chunk = eights[begin[live] + at].view("<u8")[:, 0]
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        chunk &= np.uint64((1 << 64) - 1) >> ((np.uint64(8) - left) * np.uint64(8))
        out[live] = mix(out[live] ^ chunk) + np.uint64(INVERSE)
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]], 20_240_229)
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of some texts: hash[i], begin[i] and end[i] (bytes in data), text[i] (index), place[i] (its number in its text)."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.data, np.uint8)
        space = _SPACE[data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            change = np.concatenate([[0], change])
        self.begin, self.end = change[::2], change[1::2]
        self.hash = word_hashes(self.data, self.begin, self.end)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.text = np.searchsorted(starts, self.begin, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        self.count = np.diff(np.concatenate([self.first, [len(self.begin)]]))
        self.place = np.arange(len(self.begin)) - self.first[self.text] if len(self.begin) else np.zeros(0, np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whole) of the n words from each word on; whole is False where the text ends earlier."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total = self.hash[:size].copy()
        for k in range(1, n):
            total *= np.uint64(MULTIPLIER)
            total += self.hash[k : k + size]
        return mix(total), self.text[:size] == self.text[n - 1 :]


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over each `width` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return out if have == width else pick(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])
