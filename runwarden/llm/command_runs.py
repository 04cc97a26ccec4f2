"""Periodic runs of words in command lines, caught while the words are appended."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from runwarden.llm.text_blocks import blocks, mix, multipliers, words_of

#: A run has at least this many words and this many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
_AS_IS = np.arange(256, dtype=np.uint8)
_LEFT, _RIGHT = multipliers(2, seed=13)
_PIECE = 2_000_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_DDL = "struct<start:bigint,length:bigint,period:bigint>"


def _stretch(words: np.ndarray, at: np.ndarray, period: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many of ``limit`` words from ``at`` on, in direction ``step``, equal those a period later."""
    out = np.zeros(len(at), dtype=np.int64)
    low = 0
    ends = np.cumsum(limit)
    while low < len(at):
        before = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, before + _PIECE, side="right")), low + 1)
        size = limit[low:high]
        first = np.cumsum(size) - size
        turn = np.arange(int(size.sum())) - np.repeat(first, size)
        place = np.repeat(at[low:high], size) + step * turn
        differs = words[place] != words[place + np.repeat(period[low:high], size)]
        # The place of the first difference, or the limit.
        reach = np.where(differs, turn, np.repeat(size, size))
        full = size > 0
        if full.any():
            out[low:high][full] = np.minimum.reduceat(reach, first[full])
        low = high
    return out


def catch_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in texts of hashed ``words``, text r at ``first[r]:first[r+1]``.

    Level k has a catcher for every completed block of ``s = 2**k`` words that begins at a
    multiple of s in its text.  An appended word ends one suffix of s words, which is compared
    with the one catcher that lies between s and 2s words before it: a match at distance q
    is the start of a square of period q.  Matches of neighbouring catchers at one distance
    are one repetition; what is left of it at both ends is shorter than s words and compared
    word by word.  A run of at least three periods holds two whole catchers, so none is missed.

    Suffixes and blocks are compared through hashes that double with the level.  A word's
    comparison uses only words up to it; numpy makes those of many words side by side, level
    after level.  Matches inside a run of a smaller period are repeats of that run and go
    first, which keeps the number of matches in proportion to the words.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, size = first[text], np.diff(first)[text]
    place = np.arange(len(words))
    # Furthest end of a run found so far that begins at or before a word.
    cover = np.zeros(len(words), dtype=np.int64)
    hashed, s = words.copy(), 1
    found = [], [], []
    while True:
        # Longer catchers work only in texts that can hold a run of their period.
        alive = size >= max(LEAST_PERIODS * s, LEAST_WORDS)
        if not alive.all():
            place, start, size, hashed = place[alive], start[alive], size[alive], hashed[alive]
        if not len(place):
            break
        offset = place - start
        inside = np.flatnonzero((offset >= s) & (offset + s <= size))
        # Texts are kept or dropped whole, so distances inside a text are the same in both numberings.
        apart = offset[inside] % s + s
        match = inside[hashed[inside] == hashed[inside - apart]]
        if len(match):
            period = offset[match] % s + s
            block = place[match] - period
            fresh = cover[block] < block + period + s
            match, period, block = match[fresh], period[fresh], block[fresh]
            begin, total = start[match], size[match]
        if len(match):
            order = np.lexsort((block, period, begin))
            period, block, begin, total = period[order], block[order], begin[order], total[order]
            joins = (period[1:] == period[:-1]) & (begin[1:] == begin[:-1]) & (block[1:] == block[:-1] + s)
            heads = np.flatnonzero(np.concatenate([[True], ~joins]))
            tails = np.concatenate([heads[1:], [len(block)]]) - 1
            long = tails > heads
            heads, tails = heads[long], tails[long]
            period, begin, total = period[heads], begin[heads], total[heads]
            low, high = block[heads], block[tails] + s
            left = _stretch(words, low - 1, period, np.minimum(low - begin, s - 1), -1)
            right = _stretch(words, high, period, np.minimum(begin + total - period - high, s - 1), 1)
            low, high = low - left, high + right + period
            real = high - low >= np.maximum(LEAST_PERIODS * period, LEAST_WORDS)
            low, high, period = low[real], high[real], period[real]
            for held, part in zip(found, (low, high, period), strict=True):
                held.append(part)
            np.maximum.at(cover, low, high)
            cover = np.maximum.accumulate(cover)
        # Double the windows; those that leave their text are never compared.
        following = np.concatenate([hashed[s:], np.zeros(min(s, len(hashed)), np.uint64)])
        hashed = mix(hashed * _LEFT + following * _RIGHT)
        s *= 2
    low, high, period = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    order = np.lexsort((period, low))
    return low[order], high[order], period[order]


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> pa.Array:
    """Strings of words joined by one space; words ``first[r]:first[r+1]`` make string r."""
    size = end - start + 1
    last = first[1:][first[1:] > first[:-1]] - 1
    size[last] -= 1
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(ends[-1]), dtype=np.uint8)
    low = 0
    while low < len(start):
        high = max(int(np.searchsorted(ends, ends[low] + _PIECE, side="right")) - 1, low + 1)
        turn = np.arange(ends[low], ends[high])
        source = turn + np.repeat(start[low:high] - ends[low:high], size[low:high])
        out[ends[low] : ends[high]] = data[np.minimum(source, len(data) - 1)]
        low = high
    spaces = np.ones(len(start), dtype=bool)
    spaces[last] = False
    out[ends[1:][spaces] - 1] = 0x20
    bounds = ends[first].astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_string(), len(first) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())]
    ).cast(pa.string())


def _strongest(length: list[int], period: list[int]) -> int:
    """Place of the run with the greatest length / period; the first of equals."""
    best = 0
    for i in range(1, len(length)):
        if length[i] * period[best] > length[best] * period[i]:
            best = i
    return best


def command_runs(executions: DataFrame) -> DataFrame:
    """Periodic runs of words in every whole command line, and the line without the repeats.

    ``executions``: ``event_id`` (any type), ``command_line``.  Words are ``[^\\x20\\x09-\\x0D]+``,
    numbered from 0.  A run is a stretch with smallest period q in words and at least
    ``max(6, 4 q)`` words that no neighbouring word extends; loops, padding and copied options
    of generated command lines look like that.  Returns per row ``event_id, n_words, n_runs``,
    ``runs`` (array of ``start, length, period``, by start and period), ``strongest`` (the run
    with the greatest exact length / period; ties: smallest start, then period; null without
    a run) and ``collapsed``: the words joined by one space, without those that a run
    contains after its first period.

    Method: online dyadic square catching, see ``catch_runs``; rows are independent, so nothing
    is shuffled and a lost task is repeated alone.  Work is near n log n in the words of a
    line.  Words and windows are told apart by 64-bit hashes.

    Defined cases: a null or empty line, or one of white space, has no words, no runs and an
    empty ``collapsed``; repeated rows and null ids stay as they are; a line longer than a
    block is handled whole; an empty table gives no rows; other columns are ignored.
    """
    executions = executions.select("event_id", "command_line")
    kind = executions.schema["event_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def work(batches):
        for block in blocks(batches, "command_line"):
            words = words_of(block.column("command_line"))
            low, high, period = catch_runs(words.hashes(_AS_IS), words.first)
            dropped = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(dropped, low + period, 1)
            np.add.at(dropped, high, -1)
            kept = np.cumsum(dropped)[:-1] == 0
            places = np.concatenate([[0], np.cumsum(kept)])[words.first]
            owner = np.searchsorted(words.first, low, side="right") - 1
            bounds = np.searchsorted(owner, np.arange(block.num_rows + 1))
            start, length = low - words.first[owner], high - low
            runs = pa.StructArray.from_arrays(
                [pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN)
            )
            strongest = [
                a + _strongest(length[a:b].tolist(), period[a:b].tolist()) if b > a else None
                for a, b in zip(bounds.tolist(), bounds[1:].tolist())
            ]
            yield pa.record_batch(
                {
                    "event_id": block.column("event_id").cast(arrow_kind),
                    "n_words": pa.array(words.counts, pa.int64()),
                    "n_runs": pa.array(np.diff(bounds), pa.int64()),
                    "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
                    "strongest": runs.take(pa.array(strongest, pa.int64())),
                    "collapsed": _joined(words.data, words.start[kept], words.end[kept], places),
                }
            )

    return executions.mapInArrow(
        work,
        f"event_id {kind.simpleString()}, n_words bigint, n_runs bigint, runs array<{_RUN_DDL}>, "
        f"strongest {_RUN_DDL}, collapsed string",
    )
