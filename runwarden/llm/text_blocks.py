"""Words and their hashes straight from the buffers of Arrow string columns.

All helpers work on whole blocks of rows with numpy.  A block holds a few megabytes of
text, so memory does not depend on the number of rows in a batch.  A single longer text
forms a block of its own and is hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4_000_000
#: Bytes or characters that are worked on at once; the places and sums that numpy makes of them take many times as much.
_PIECE_BYTES = 1 << 18

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(count: int, seed: int = 1) -> np.ndarray:
    """Odd random factors, one for each position; always the same for a seed."""
    places = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(places + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64)) | np.uint64(1)


_FACTORS = multipliers(512)


def _factors(count: int) -> np.ndarray:
    return _FACTORS[:count] if count <= len(_FACTORS) else multipliers(count)


def blocks(batches, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        texts = batch.column(column)
        if pa.types.is_large_string(texts.type):
            bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)
        else:
            bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)
        bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        first = 0
        while first < batch.num_rows:
            after = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
            after = min(max(after, first + 1), batch.num_rows)
            yield batch.slice(first, after - first)
            first = after


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row bounds) of a string column; null is empty."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=kind)
    bounds = bounds[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    data = data[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if texts.null_count:
        holes = np.flatnonzero(np.asarray(texts.is_null()))
        if (bounds[holes + 1] > bounds[holes]).any():
            return raw_bytes(texts.fill_null(""))
    return data, bounds


class Words:
    """Words of a block: ``start`` and ``end`` in ``data``, ``first[r]:first[r+1]`` for row r."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray = WORD_BYTES):
        self.data, self.bounds = data, bounds
        inside = word_bytes[data]
        begins, stops = inside.copy(), inside.copy()
        if len(data):
            begins[1:] &= ~inside[:-1]
            stops[:-1] &= ~inside[1:]
            edges = np.unique(bounds[(bounds > 0) & (bounds < len(data))])
            begins[edges] = inside[edges]
            stops[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, bounds).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, table: np.ndarray = LOWER) -> np.ndarray:
        """64-bit hash of every word after mapping its bytes through ``table``."""
        out = np.empty(len(self), dtype=np.uint64)
        lengths = self.end - self.start
        total = np.cumsum(lengths)
        low = 0
        while low < len(self):
            before = total[low - 1] if low else 0
            high = int(np.searchsorted(total, before + _PIECE_BYTES, side="right"))
            high = max(high, low + 1)
            size = lengths[low:high]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) - np.repeat(ends - size, size)
            chars = table[self.data[place + np.repeat(self.start[low:high], size)]]
            values = (chars.astype(np.uint64) + np.uint64(1)) * _factors(int(size.max()))[place]
            sums = np.add.reduceat(values, ends - size)
            out[low:high] = mix(sums + size.astype(np.uint64))
            low = high
        return out


def words_of(texts: pa.Array, word_bytes: np.ndarray = WORD_BYTES) -> Words:
    return Words(*raw_bytes(texts), word_bytes)


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row bounds) of UTF-8 bytes, decoded piece by piece."""
    lead = (data & 0xC0) != 0x80
    out = np.empty(np.count_nonzero(lead), dtype=np.uint32)
    ends = np.empty(len(bounds), dtype=np.int64)
    done = row = 0
    for low in range(0, len(data), _PIECE_BYTES):
        inside = lead[low : low + _PIECE_BYTES]
        at = np.flatnonzero(inside)
        after = int(np.searchsorted(bounds, low + len(inside)))  # a bound at the end is of the next piece
        ends[row:after] = done + np.searchsorted(at, bounds[row:after] - low)
        out[done : done + len(at)] = _code_points(data[low : low + len(inside) + 3], at)
        done, row = done + len(at), after
    ends[row:] = done
    return out, ends


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at the places ``at``."""
    out = data[at].astype(np.uint32)
    long = np.flatnonzero(out >= 0xC0)
    if len(long):
        first, place = out[long], at[long]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        rest = [padded[place + i].astype(np.uint32) & 0x3F for i in (1, 2, 3)]
        out[long] = np.select(
            [first < 0xE0, first < 0xF0],
            [((first & 0x1F) << 6) | rest[0], ((first & 0x0F) << 12) | (rest[0] << 6) | rest[1]],
            ((first & 0x07) << 18) | (rest[0] << 12) | (rest[1] << 6) | rest[2],
        )
    return out


def grams(codes: np.ndarray, bounds: np.ndarray, orders: range, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams that stay inside a row: (buckets, row bounds).

    ``buckets`` is a power of two.  The grams of a row stand together, order by order.
    """
    sizes = np.diff(bounds)
    counts = np.stack([np.maximum(sizes - n + 1, 0) for n in orders])
    ends = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
    out = np.empty(int(ends[-1]), dtype=np.int32)
    factors = multipliers(max(orders), seed=2)
    wide = codes.astype(np.uint64) + np.uint64(1)
    at = ends[:-1].copy()
    for row, n in enumerate(orders):
        if len(wide) < n:
            continue
        value = np.full(len(wide) - n + 1, n, dtype=np.uint64)
        for step in range(n):
            value += wide[step : step + len(value)] * factors[step]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        hashed = (value >> np.uint64(40)).astype(np.int32) & np.int32(buckets - 1)
        have = counts[row]
        source = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
        out[source + np.repeat(at, have)] = hashed[source + np.repeat(bounds[:-1], have)]
        at += have
    return out, ends
