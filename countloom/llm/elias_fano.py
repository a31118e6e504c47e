"""Elias-Fano sequences over NumPy arrays, so they can be memory-mapped and searched in bulk."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each 64-bit word."""
    x, k, at = x.copy(), k.astype(np.int64), np.zeros(len(x), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
        up = k >= below
        k -= below * up
        at += half * up
        x >>= (half * up).astype(np.uint64)
    return at


class EliasFano:
    """Strictly or weakly ascending integers below 2**63.

    Values are cut into low bits, packed as they are, and high parts, kept in unary
    in a bit vector with a count of ones by word.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self._zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int | None = None) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = universe if universe is not None else (int(values[-1]) + 1 if n else 1)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        top = int(values[-1]) >> bits if n else 0
        at = (values >> bits) + np.arange(n)
        size = (n + top + 2 + 63) // 64
        high = np.packbits(np.bincount(at, minlength=size * 64).astype(bool), bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            v = (values & ((1 << bits) - 1)).astype(np.uint64)
            place = np.arange(n, dtype=np.int64) * bits
            word, off = place >> 6, (place & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, v << off)
            over = (off.astype(np.int64) + bits) > 64
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (np.uint64(64) - off[over]))
        return cls(n, bits, low, high, ones)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"shape": np.array([self.n, self.bits]), "low": self.low, "high": self.high, "ones": self.ones}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> EliasFano:
        n, bits = (int(x) for x in arrays["shape"])
        return cls(n, bits, arrays["low"], arrays["high"], arrays["ones"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        place = i * self.bits
        word, off = place >> 6, (place & 63).astype(np.uint64)
        v = self.low[word] >> off
        # A shift by 64 is not defined, so the next word is shifted twice.
        v |= (self.low[word + 1] << _ONE) << (np.uint64(63) - off)
        return (v & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((at - i) << self.bits) | self._low(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below h."""
        out = np.zeros(len(h), np.int64)
        some = h > 0
        k = h[some] - 1
        word = np.searchsorted(self._zeros, k, "right") - 1
        past = word >= len(self.high)  # beyond all values
        word = np.minimum(word, len(self.high) - 1)
        at = word * 64 + _select_in_word(~self.high[word], np.minimum(k - self._zeros[word], 63))
        out[some] = np.where(past, self.n, np.minimum(at - k, self.n))
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value of at least x (n: none)."""
        x = np.asarray(x, np.int64)
        h, low = x >> self.bits, x & ((1 << self.bits) - 1)
        at, end = self._bucket(h), self._bucket(h + 1)
        # Values of one high part may be many where keys cluster, so they are halved, not walked.
        open_ = np.flatnonzero(at < end)
        while len(open_):
            mid = (at[open_] + end[open_]) >> 1
            less = self._low(mid) < low[open_]
            at[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
            open_ = open_[at[open_] < end[open_]]
        return at

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1."""
        x = np.asarray(x, np.int64)
        at = self.successor(x)
        ok = at < self.n
        ok[ok] = self.access(at[ok]) == x[ok]
        return np.where(ok, at, -1)
