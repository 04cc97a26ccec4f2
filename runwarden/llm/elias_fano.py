"""Monotone integer sequences in Elias-Fano form, queried by whole arrays."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a rank directory.

    ``arrays`` are plain numpy arrays and may be memory maps; nothing is decoded as a whole.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self.size, self.bits = (int(x) for x in arrays["shape"])

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        count = len(values)
        top = int(values[-1]) if count else 0
        bits = max(0, (top // max(count, 1)).bit_length() - 1)
        upper = (values >> np.uint64(bits)).astype(np.int64)
        length = count + (top >> bits) + 2
        unary = np.zeros(-(-length // 64) * 64, dtype=np.uint8)
        unary[upper + np.arange(count)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        low = np.zeros(-(-count * bits // 64) + 2, dtype=np.uint64)
        if bits:
            rests = values & np.uint64((1 << bits) - 1)
            at = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, rests << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, rests[over] >> (np.uint64(64) - shift[over]))
        return {"low": low, "high": high, "zeros": zeros, "shape": np.array([count, bits], dtype=np.int64)}

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), dtype=np.uint64)
        at = index.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        rest = (np.uint64(64) - shift) & np.uint64(63)
        value |= np.where(shift > 0, self.low[word + 1] << rest, np.uint64(0))
        return value & np.uint64((1 << self.bits) - 1)

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Positions of the rank-th (from 0) set or clear bits of the upper part."""
        directory = np.arange(len(self.zeros)) * 64 - self.zeros if ones else self.zeros
        word = np.searchsorted(directory, rank, side="right") - 1
        left = (rank - directory[word]).astype(np.uint64)
        bits = self.high[word] if ones else ~self.high[word]
        place = np.zeros(len(rank), dtype=np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.uint64)
            skip = left >= below
            left -= np.where(skip, below, np.uint64(0))
            bits = np.where(skip, bits >> np.uint64(width), bits)
            place += np.where(skip, np.uint64(width), np.uint64(0))
        return word * 64 + place.astype(np.int64)

    def access(self, index: np.ndarray) -> np.ndarray:
        upper = (self._select(index, ones=True) - index).astype(np.uint64)
        return (upper << np.uint64(self.bits)) | self._lows(index)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element that is at least each value, ``size`` when there is none."""
        out = np.full(len(values), self.size, dtype=np.int64)
        if not self.size or not len(values):
            return out
        values = values.astype(np.uint64)
        upper = (values >> np.uint64(self.bits)).astype(np.int64)
        last = int(self.access(np.array([self.size - 1]))[0] >> np.uint64(self.bits))
        at = np.flatnonzero(upper <= last)
        if not len(at):
            return out
        upper = upper[at]
        begin = np.zeros(len(at), dtype=np.int64)
        inner = upper > 0
        begin[inner] = self._select(upper[inner] - 1, ones=False) - (upper[inner] - 1)
        end = self._select(upper, ones=False) - upper
        wanted = values[at] & np.uint64((1 << self.bits) - 1)
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) >> 1
            less = self._lows(middle) < wanted[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        out[at] = begin
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is missing."""
        place = self.successor(values)
        inside = np.flatnonzero(place < self.size)
        same = self.access(place[inside]) == values[inside].astype(np.uint64)
        out = np.full(len(values), -1, dtype=np.int64)
        out[inside[same]] = place[inside[same]]
        return out
