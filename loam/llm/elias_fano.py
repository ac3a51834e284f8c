"""Elias-Fano sequences and one level of an n-gram trie over them (helpers that run inside Spark tasks).

A level holds, for sorted contexts, the sorted successors of each.  Contexts, the pointers to where each
one's successors begin, and the successors themselves are monotone sequences: a successor is stored on
top of the last value of the context before, and is found by a successor search inside its context's
range.  All parts are plain arrays that can be written to a file and mapped from it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import BinaryIO

import numpy as np

_U = np.uint64
#: A probability is stored as one plus its negative decimal logarithm in these units; 0 stands for none.
UNITS = 4096


_EIGHT, _TOP = _U(0x0101010101010101), _U(0x8080808080808080)
#: For each byte and rank, the place of the set bit of that rank.
_IN_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.int64).ravel()


def _or_at(words: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """words[at] |= value, for ascending places that may repeat."""
    if len(at):
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[new]] |= np.bitwise_or.reduceat(value, new)


@dataclass
class EliasFano:
    """A sequence of non-decreasing integers: their low bits packed, their high bits in unary with ones counted before each 64 bits."""

    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray
    size: int
    width: int
    most: int

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // max(n, 1)).bit_length() - 1)
        places = (values >> width) + np.arange(n)
        bits = np.zeros((n + (most >> width) + 1 + 63) // 64 * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(_U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        low = np.zeros((n * width + 63) // 64 + 1, _U)
        if width and n:
            start = np.arange(n) * width
            word, shift = start >> 6, (start & 63).astype(_U)
            part = values.astype(_U) & _U((1 << width) - 1)
            _or_at(low, word, part << shift)
            over = np.flatnonzero(shift + _U(width) > 64)
            low[word[over] + 1] |= part[over] >> (_U(64) - shift[over])
        return cls(low, high, ones, n, width, most)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        start = i * self.width
        word, shift = start >> 6, (start & 63).astype(_U)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((_U(64) - shift) & _U(63)), _U(0))
        return (value & _U((1 << self.width) - 1)).astype(np.int64)

    @staticmethod
    def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The place of the set bit with so many set ones below it, in each of some words."""
        x = words - ((words >> _U(1)) & _U(0x5555555555555555))
        x = (x & _U(0x3333333333333333)) + ((x >> _U(2)) & _U(0x3333333333333333))
        x = ((x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EIGHT  # byte k: set bits in the bytes up to k
        wanted = rank.astype(_U)
        byte = np.bitwise_count((((wanted * _EIGHT) | _TOP) - x) & _TOP)  # bytes at whose end there are not more than that
        below = np.where(byte > 0, (x >> (byte.astype(_U) * _U(8) - _U(8) & _U(63))) & _U(255), _U(0))
        own = (words >> (byte.astype(_U) * _U(8))) & _U(255)
        return byte.astype(np.int64) * 8 + _IN_BYTE[(own << _U(3)) | ((wanted - below) & _U(7))]

    def _select_one(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, rank, side="right") - 1
        return (word << 6) + self._in_word(self.high[word], rank - self.ones[word])

    @cached_property
    def _zeros(self) -> np.ndarray:
        return (np.arange(len(self.ones)) << 6) - self.ones

    def _select_zero(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self._zeros, rank, side="right") - 1
        return (word << 6) + self._in_word(~self.high[word], rank - self._zeros[word])

    def _window(self, place: np.ndarray) -> np.ndarray:
        """The 64 bits of the high part from a place on."""
        word, shift = place >> 6, (place & 63).astype(_U)
        inside = np.minimum(word, len(self.high) - 1)
        after = self.high[np.minimum(inside + 1, len(self.high) - 1)] << ((_U(64) - shift) & _U(63))
        both = (self.high[inside] >> shift) | np.where((shift > 0) & (word + 1 < len(self.high)), after, _U(0))
        return np.where(word < len(self.high), both, _U(0))

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return (self._select_one(i) - i << self.width) | self._lows(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and i + 1."""
        here = self._select_one(i)
        window = self._window(here + 1)
        there = here + 1 + np.bitwise_count(~window & (window - _U(1))).astype(np.int64)
        far = np.flatnonzero(window == 0)
        if len(far):
            there[far] = self._select_one(i[far] + 1)
        return (here - i << self.width) | self._lows(i), (there - i - 1 << self.width) | self._lows(i + 1)

    def _search(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the first place of begin <= place < end whose value is x or more, else end; whether that value is x)."""
        top = np.minimum(x, self.most) >> self.width
        zero = np.where(top > 0, self._select_zero(np.maximum(top - 1, 0)), -1)
        window = self._window(zero + 1)
        run = np.bitwise_count(window & ~(window + _U(1))).astype(np.int64)  # ones in a row: values with these high bits
        first = zero + 1 - top
        long = np.flatnonzero(run == 64)
        if len(long):
            run[long] = self._select_zero(top[long]) - top[long] - first[long]
        at, to = np.clip(first, begin, end), np.clip(first + run, begin, end)
        low, stop = x & ((1 << self.width) - 1), to.copy()
        open_ = np.flatnonzero(at < to)
        while len(open_):
            middle = (at[open_] + to[open_]) >> 1
            less = self._lows(middle) < low[open_]
            at[open_] = np.where(less, middle + 1, at[open_])
            to[open_] = np.where(less, to[open_], middle)
            open_ = open_[at[open_] < to[open_]]
        at = np.where(x > self.most, end, at)
        same = (at < stop) & (x <= self.most)
        some = np.flatnonzero(same)
        same[some] = self._lows(at[some]) == low[some]
        return at, same

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each x, the first place of begin <= place < end whose value is x or more; end if there is none."""
        return self._search(x, begin, end)[0]

    def place(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each x, a place of begin <= place < end that has it; -1 if there is none."""
        at, same = self._search(x, begin, end)
        return np.where(same, at, -1)


_PARTS = ("low", "high", "ones")


@dataclass
class Level:
    """Successors of contexts with quantised probabilities."""

    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    codes: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, successor: np.ndarray, count: np.ndarray, total: np.ndarray, discount: float) -> Level:
        """Of entries sorted by context and successor; total: the context's count at each entry."""
        n = len(context)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if n else np.empty(0, np.int64)
        last = np.append(first[1:], n) - 1 if n else first
        base = np.concatenate([[0], np.cumsum(successor[last] + 1)])[:-1] if n else np.empty(0, np.int64)
        return cls(EliasFano.of(context[first]), EliasFano.of(np.append(first, n)), EliasFano.of(successor + np.repeat(base, last - first + 1)), code_of(count, total, discount).astype(np.uint16))

    def save(self, file: BinaryIO) -> list:
        """Writes all arrays, and returns what `load` needs to map them."""
        index: list = []
        for s in (self.contexts, self.pointers, self.successors):
            index.append((s.size, s.width, s.most))
            arrays = [getattr(s, p) for p in _PARTS]
            index += [_put(file, a) for a in arrays]
        return [*index, _put(file, self.codes)]

    @classmethod
    def load(cls, file: BinaryIO, index: list) -> Level:
        """The level with its arrays mapped from the file."""
        sequences = []
        for k in range(0, 12, 4):
            size, width, most = index[k]
            sequences.append(EliasFano(*(_map(file, x) for x in index[k + 1 : k + 4]), size, width, most))
        return cls(*sequences, _map(file, index[12]))

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each context's successors begin and end, nowhere for one that has none; and on top of what they are stored."""
        begin, end, base = (np.zeros(len(context), np.int64) for _ in range(3))
        if self.contexts.size and len(context):
            at = self.contexts.place(context, begin, np.full(len(context), self.contexts.size))
            found = np.flatnonzero(at >= 0)
            begin[found], end[found] = self.pointers.pair(at[found])
            later = found[begin[found] > 0]
            base[later] = self.successors.get(begin[later] - 1) + 1
        return begin, end, base

    def find(self, begin: np.ndarray, end: np.ndarray, base: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The place of a successor in its context's range, -1 if it isn't there."""
        return self.successors.place(base + successor, begin, end) if self.successors.size else np.full(len(begin), -1)


#: What each code of 16 bits stands for.
_PROBABILITIES = np.append(0.0, 10.0 ** (-np.arange(65535.0) / UNITS))


def code_of(count: np.ndarray, total: np.ndarray, discount: float) -> np.ndarray:
    """The quantised discounted probability of a count (1 or more) out of a total."""
    return np.minimum(1 + np.rint(-np.log10((count - discount) / np.maximum(total, count)) * UNITS), 65535).astype(np.int64)


def probability(codes: np.ndarray) -> np.ndarray:
    """What codes stand for."""
    return _PROBABILITIES[codes]


def _put(file: BinaryIO, array: np.ndarray) -> tuple[int, str, int]:
    at = -file.seek(0, 2) % 8
    file.write(b"\0" * at)
    where = file.tell()
    file.write(np.ascontiguousarray(array).tobytes())
    return where, array.dtype.str, len(array)


def _map(file: BinaryIO, where: tuple[int, str, int]) -> np.ndarray:
    at, kind, n = where
    file.flush()
    return np.asarray(np.memmap(file, kind, "r", at, (n,))) if n else np.empty(0, kind)
