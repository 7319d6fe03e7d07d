"""Elias-Fano code of increasing sequences in numpy arrays that may be memory-mapped."""
from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_CHUNK = 1 << 15  # queries worked on at a time, so that intermediate arrays stay in the cache
_M = [np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80")]
#: Place of the k-th one in a byte, at [k * 256 + byte].
_IN_BYTE = np.array([next((i for i in range(8) if (byte >> i) & 1 and bin(byte & ((1 << i) - 1)).count("1") == k), 0)
                     for k in range(8) for byte in range(256)], np.uint8)


def _in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one (from 0) of each 64-bit word: counts per byte side by side, then a table."""
    x = w - ((w >> _ONE) & _M[0])
    x = (x & _M[1]) + ((x >> np.uint64(2)) & _M[1])
    x = ((x + (x >> np.uint64(4))) & _M[2]) * _M[3]  # byte i: ones up to and with byte i
    k = k.astype(np.uint64)
    more = ((x | _M[4]) - (k + _ONE) * _M[3]) & _M[4]  # high bit of the bytes that have more than k
    at = (np.uint64(8) - np.bitwise_count(more)) << np.uint64(3)
    k -= ((x << np.uint64(8)) >> at) & np.uint64(255)
    return at.astype(np.int64) + _IN_BYTE[(k << np.uint64(8)) | ((w >> at) & np.uint64(255))]


def _by_chunks(n: int, parts: int, one) -> list[np.ndarray]:
    got = [one(slice(i, i + _CHUNK)) for i in range(0, n, _CHUNK)]
    return [np.concatenate([g[j] for g in got]) for j in range(parts)]


class EliasFano:
    """n < 2^31 values v[0] <= v[1] <= ...: the low bits packed side by side, the high ones in unary, and for each
    word of the latter how many ones and how many zeros come before it. ``arrays`` is all there is to store, ``meta`` how to read it."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.l, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @classmethod
    def build(cls, v: np.ndarray) -> "EliasFano":
        v = np.asarray(v, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * l + 63) // 64 + 1, np.uint64)
        if l:
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = v & np.uint64((1 << l) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(l) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        # value i sets bit (v >> l) + i; a zero ends each bucket of equal high parts
        bit = (v >> np.uint64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros(((top >> l) + n + 1 + 63) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, bit >> 6, _ONE << (bit & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.int32)
        return cls(n, l, low, high, ones, np.arange(len(ones), dtype=np.int32) * 64 - ones)

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones, self.zeros]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        # a shift by 64 is not defined, so the upper part goes in two steps
        x = (self.low[word] >> shift) | ((self.low[word + 1] << (np.uint64(63) - shift)) << _ONE)
        return x & np.uint64((1 << self.l) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """The place of the k-th one (or zero) of the high bits, from 0."""
        before = self.zeros if zeros else self.ones
        word = np.searchsorted(before, k.astype(np.int32), "right") - 1
        w, left = self.high[word], k - before[word]
        w = ~w if zeros else w
        return word * 64 + _in_word(w, left)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return _by_chunks(len(i), 1, lambda c: (self._access(i[c]),))[0]

    def _access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, False) - i).astype(np.uint64) << np.uint64(self.l)) | self._lows(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether it equals x); the place is n where there is none."""
        x = np.asarray(x, np.uint64)
        if not len(x) or not self.n:
            return np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        at, found = _by_chunks(len(x), 2, lambda c: self._successor(x[c]))
        return at, found

    def _successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, low = (x >> np.uint64(self.l)).astype(np.int64), x & np.uint64((1 << self.l) - 1)
        top = int(self.zeros[-1])
        far = h >= top
        h = np.minimum(h, top - 1)
        # the bucket of x's high part, then a binary search over its low bits
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) + 1, 0) - h
        end = self._select(h, True) - h
        lo, hi = begin.copy(), np.where(far, begin, end)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            up = self._lows(mid) < low[todo]
            lo[todo] = np.where(up, mid + 1, lo[todo])
            hi[todo] = np.where(up, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        found = np.zeros(len(x), bool)
        some = np.flatnonzero((lo < end) & ~far)
        found[some] = self._lows(lo[some]) == low[some]
        return np.where(far, self.n, lo), found
