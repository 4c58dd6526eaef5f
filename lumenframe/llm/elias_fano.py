"""Elias-Fano sequences in flat arrays that can be memory-mapped, searched many at a time.

The low bits of each number stand side by side; the high bits are a bit vector in which the i-th one bit stands at the high
part plus i. Counts of ones before each word of 64 bits make its one and zero bits addressable.
"""

from __future__ import annotations

import json
import mmap
from dataclasses import dataclass

import numpy as np

_U = np.uint64


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one bit of each word."""
    place = np.zeros(len(word), dtype=np.int64)
    word, k = word.copy(), k.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.int64)
        up = k >= ones
        place += width * up
        k -= ones * up
        word = np.where(up, word >> _U(width), word)
    return place


@dataclass
class EliasFano:
    """A sequence that does not fall, of numbers below 2^62."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray  # one bits before each word of ``high``

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(1, _U), np.zeros(1, _U), np.zeros(1, np.int64))
        bits = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, dtype=_U)
        if bits:
            part = values.astype(_U) & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.add.reduceat(part << shift, first)  # the numbers' bits don't meet, so sums are unions
            over = (at & 63) + bits > 64
            low[word[over] + 1] |= part[over] >> (_U(64) - shift[over])  # at most one number runs over into a word
        place = (values >> bits) + np.arange(n)
        flags = np.zeros(((int(place[-1]) + 1 + 63) // 64 + 1) * 64, dtype=np.uint8)  # ends with a word of zeros
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(_U)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]]
        return cls(n, bits, low, high, ones)

    def _one(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, k, side="right") - 1
        return word * 64 + _select_in_word(self.high[word], k - self.ones[word])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero bit; the end of the bits if there are fewer."""
        zeros = np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(zeros, k, side="right") - 1
        left = np.minimum(k - zeros[word], 63 - np.bitwise_count(self.high[word]).astype(np.int64))
        return word * 64 + _select_in_word(~self.high[word], left)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        value = self.low[word] >> shift
        over = (at & 63) + self.low_bits > 64
        more = self.low[word[over] + 1] << (_U(64) - shift[over])
        value[over] |= more
        return (value & _U((1 << self.low_bits) - 1)).astype(np.int64)

    def values(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``."""
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return i
        return ((self._one(i) - i) << self.low_bits) | self._lows(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each ``x`` the place of its successor (the first number not below it), and whether that equals it.

        The numbers with the high part of ``x`` are the one bits behind the zero bit that ends the part before.
        """
        x = np.asarray(x, dtype=np.int64)
        if not self.n or not len(x):
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        top = (len(self.ones) - 1) * 64 - int(self.ones[-1])  # zero bits before the last word
        head = np.minimum(x >> self.low_bits, top)
        bit = np.where(head > 0, self._zero(np.maximum(head - 1, 0)) + 1, 0)  # where the part of ``x`` begins
        lo = bit - head
        word, shift = bit >> 6, (bit & 63).astype(_U)
        clear = ~self.high[word] >> shift  # a set bit for each zero bit from there on
        size = np.bitwise_count((clear & (~clear + _U(1))) - _U(1)).astype(np.int64)  # one bits before the first of them
        over = np.flatnonzero(clear == 0)  # none in this word
        if len(over):
            size[over] = self._zero(head[over]) - bit[over]
        last = np.minimum(lo + size, self.n)
        lo = np.minimum(lo, self.n)
        tail = x & ((1 << self.low_bits) - 1)
        far = (x >> self.low_bits) > top
        if far.any():
            tail[far] = np.int64(1) << 62
        hi = last.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._lows(middle) < tail[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
            open_ = open_[lo[open_] < hi[open_]]
        equal = lo < last
        some = np.flatnonzero(equal)
        equal[some] = self._lows(lo[some]) == tail[some]
        return lo, equal


@dataclass
class Lists:
    """Sorted lists of small numbers, one per context, as one rising sequence: the numbers of a list stand above the last
    number of the list before it. ``starts`` points at the first place of each list, and ends with the length."""

    starts: EliasFano
    items: EliasFano

    @classmethod
    def build(cls, sizes: np.ndarray, numbers: np.ndarray) -> Lists:
        """``sizes``: the length of each list; ``numbers``: all lists one after the other."""
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        base = np.zeros(len(ends), dtype=np.int64)
        if len(numbers):
            base[1:] = np.cumsum(np.where(sizes, numbers[ends - 1] + 1, 0))[:-1]
        return cls(EliasFano.build(np.r_[0, ends]), EliasFano.build(np.repeat(base, sizes) + numbers))

    def bounds(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and base of the lists of these contexts."""
        start, end = self.starts.values(contexts), self.starts.values(contexts + 1)
        base = np.zeros(len(start), dtype=np.int64)
        later = np.flatnonzero(start > 0)
        base[later] = self.items.values(start[later] - 1) + 1
        return start, end, base

    def find(self, bounds: tuple[np.ndarray, np.ndarray, np.ndarray], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each number stands in its list (place in all lists), and whether it is there."""
        place, equal = self.items.find(bounds[2] + numbers)
        return place, equal & (place < bounds[1])


def flatten(parts: dict) -> tuple[dict, list[np.ndarray]]:
    """Header and arrays of named sequences, lists and plain arrays."""
    head, arrays = {}, []

    def add(value):
        if isinstance(value, Lists):
            return {"lists": [add(value.starts), add(value.items)]}
        if isinstance(value, EliasFano):
            return {"n": value.n, "bits": value.low_bits, "parts": [add(value.low), add(value.high), add(value.ones)]}
        arrays.append(np.ascontiguousarray(value))
        return len(arrays) - 1

    for name, value in parts.items():
        head[name] = add(value)
    return head, arrays


def dump(parts: dict) -> list[bytes]:
    """Pieces of a file: length of the header, header, and the arrays, each from a multiple of 8 bytes."""
    head, arrays = flatten(parts)
    at, places = 0, []
    for a in arrays:
        places.append([at, len(a), a.dtype.str])
        at += -(-a.nbytes // 8) * 8
    text = json.dumps({"head": head, "arrays": places}).encode()
    text += b" " * (-len(text) % 8)
    return [len(text).to_bytes(8, "little"), text, *(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)]


def load(mapped: mmap.mmap | bytes) -> dict:
    """Views of the arrays in a mapped file."""
    size = int.from_bytes(mapped[:8], "little")
    meta = json.loads(mapped[8:8 + size])

    def array(k: int) -> np.ndarray:
        at, n, kind = meta["arrays"][k]
        return np.frombuffer(mapped, dtype=kind, count=n, offset=8 + size + at) if n else np.zeros(0, kind)

    def get(x):
        if isinstance(x, int):
            return array(x)
        if "lists" in x:
            return Lists(*map(get, x["lists"]))
        return EliasFano(x["n"], x["bits"], *map(array, x["parts"]))

    return {name: get(x) for name, x in meta["head"].items()}
