"""Trial command lines that leaked into the executions of a baseline, by spaced-seed hashing."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.text_blocks import Words, blocks, characters, mix, multipliers, raw_bytes
from runwarden.session import bound_batches

#: Token positions that a seed looks at, out of a span of 11; the others may differ.  Every window of
#: 13 tokens with two changed ones holds a start at which one of them sees equal tokens only.
MASKS = ((0, 1, 2, 5, 8, 10), (0, 2, 3, 4, 7, 10), (0, 1, 4, 6, 9, 10), (0, 3, 5, 6, 8, 10))
SPAN = 11
WINDOW = 13
MATCH_PERCENT = 80
#: Periods of repeated tokens, in tokens, whose equal alignments are tried once.
PERIODS = 8
#: Text that a worker cuts into tokens at once.
BLOCK_TEXT = 1_000_000
_PIECE = 1 << 18
#: Trial texts that one pass over the executions looks for; more are looked for in more passes.
PASS_BYTES = 32_000_000

#: Writing without spaces, by blocks of code points: a character is a token of its own.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
)
_FACTORS = multipliers(WINDOW, seed=5)
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its kind (0 between tokens, 1 in a token, 2 a token of its own) and its lower case."""
    if not _TABLES:
        kind, lower = np.zeros(0x110000, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalnum() or unicodedata.category(char)[0] == "M":
                kind[code] = 1
                low = char.lower()
                if len(low) == 1:
                    lower[code] = ord(low)
        for first, last in UNSPACED:
            kind[first : last + 1] *= 2
        _TABLES.append((kind, lower))
    return _TABLES[0]


class _Tokens(Words):
    """Tokens of code points, for ``Words.hashes``."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        kind, _ = _tables()
        self.data, self.bounds = codes, bounds
        found = kind[codes]
        inside, alone = found > 0, found == 2
        begins, stops = inside.copy(), inside.copy()
        if len(codes):
            begins[1:] &= ~inside[:-1] | alone[1:] | alone[:-1]
            stops[:-1] &= ~inside[1:] | alone[1:] | alone[:-1]
            edges = np.unique(bounds[(bounds > 0) & (bounds < len(codes))])
            begins[edges] = inside[edges]
            stops[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, bounds).astype(np.int64)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row bounds) of the tokens of texts.

    A token is a run of letters, digits and their marks, in lower case; in writing without
    spaces (``UNSPACED``) each character is one.
    """
    tokens = _Tokens(*characters(*raw_bytes(texts)))
    return tokens.hashes(_tables()[1]), tokens.first


def masks_of(size: int) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """(span, masks) for trials of ``size`` tokens.

    A trial shorter than the window has one start, so its masks cover every set of changed places:
    the places are dealt into two groups more than may change, and each mask leaves out as many
    groups as places may change.
    """
    if size >= WINDOW:
        return SPAN, MASKS
    changed = size - -(-MATCH_PERCENT * size // 100)
    if not changed:
        return size, (tuple(range(size)),)
    kept = combinations(range(changed + 2), 2)
    return size, tuple(tuple(p for p in range(size) if p % (changed + 2) in groups) for groups in kept)


def seeds(tokens: np.ndarray, mask: int, size: int) -> np.ndarray:
    """Hash at every start of the tokens that a mask for trials of ``size`` tokens keeps."""
    span, masks = masks_of(size)
    count = max(len(tokens) - span + 1, 0)
    value = np.full(count, mask * 64 + min(size, WINDOW), dtype=np.uint64)
    for place in masks[mask]:
        value += tokens[place : place + count] * _FACTORS[place]
    return mix(value)


class SeedIndex:
    """Sorted seeds of all trial texts with a bit filter in front."""

    def __init__(self, ids: list, texts: pa.Array):
        tokens, first = tokens_of(texts)
        self.ids, self.tokens, self.first = ids, tokens, first
        sizes = np.diff(first)
        self.kinds = sorted({min(int(n), WINDOW) for n in sizes if n})
        keys, items, places = [], [], []
        rows = np.repeat(np.arange(len(sizes)), sizes)
        for kind in self.kinds:
            span, masks = masks_of(kind)
            for mask in range(len(masks)):
                found = seeds(tokens, mask, kind)
                start = np.arange(len(found))
                item = rows[start] if len(start) else start
                inside = start + span <= first[item + 1] if len(start) else np.zeros(0, bool)
                fits = inside & (np.minimum(sizes[item], WINDOW) == kind)
                keys.append(found[fits])
                items.append(item[fits])
                places.append((start - first[item])[fits])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        items = np.concatenate(items) if items else np.zeros(0, np.int64)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        order = np.lexsort((places, items, keys))
        keys, items, places = keys[order], items[order], places[order]
        bits = max(16, int(len(keys) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, dtype=bool)
        self.filter[(keys >> self.shift).astype(np.int64)] = True
        # Bit q - 1: the same seed stands q places before in the same trial.
        again = np.zeros(len(keys), dtype=np.uint8)
        if len(keys):
            changes = (keys[1:] != keys[:-1]) | (items[1:] != items[:-1])
            named = (np.concatenate([[0], np.cumsum(changes)]).astype(np.int64) << 32) + places
            for q in range(1, PERIODS + 1):
                found = np.minimum(np.searchsorted(named, named - q), len(named) - 1)
                again |= ((named[found] == named - q).astype(np.uint8) << np.uint8(q - 1)).astype(np.uint8)
        once, repeats = again == 0, again > 0
        self.once = keys[once], items[once], places[once]
        # The seeds that repeat, all for 0 and without those a seed stands q places before for q.
        self.repeated = [(keys[repeats], items[repeats], places[repeats])]
        for q in range(1, PERIODS + 1):
            other = repeats & (again & (1 << (q - 1)) == 0)
            self.repeated.append((keys[other], items[other], places[other]))

    def hits(self, tokens: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token positions, items, places in the items) of equal seeds, at least one for each shift of texts.

        Where a text and a trial repeat themselves with one small period, a seed meets the
        same seed at many places, but all pairs along a diagonal have one shift: only the first one
        in both repetitions counts.
        """
        for kind in self.kinds:
            for mask in range(len(masks_of(kind)[1])):
                found = seeds(tokens, mask, kind)
                start = np.flatnonzero(self.filter[(found >> self.shift).astype(np.int64)])
                period = np.zeros(len(start), dtype=np.int64)
                for q in range(PERIODS, 0, -1):
                    far = start >= q
                    same = found[start[far]] == found[start[far] - q]
                    again = np.flatnonzero(far)[same & (rows[start[far]] == rows[start[far] - q])]
                    period[again] = q
                for q in np.unique(period).tolist():
                    some = start[period == q]
                    for keys, items, places in (self.once, self.repeated[q]):
                        low = np.searchsorted(keys, found[some], side="left")
                        count = np.searchsorted(keys, found[some], side="right") - low
                        at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                        yield np.repeat(some, count), items[at], places[at]

    def verified(self, tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, compared, matched): the best diagonal of every row and item that leak."""
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = [np.unique(np.stack([rows[p], i, p - first[rows[p]] - q]), axis=1) for p, i, q in self.hits(tokens, rows) if len(p)]
        if not found:
            return
        row, item, shift = np.unique(np.concatenate(found, axis=1), axis=1)
        sizes, lengths = np.diff(self.first)[item], np.diff(first)[row]
        begin, end = np.maximum(0, -shift), np.minimum(sizes, lengths - shift)
        width = np.minimum(WINDOW, sizes)
        fits = end - begin >= width
        row, item, shift, begin, end, width = (x[fits] for x in (row, item, shift, begin, end, width))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        spans = np.cumsum(end - begin)
        low = 0
        while low < len(row):  # many alignments side by side, in pieces
            before = spans[low - 1] if low else 0
            high = max(int(np.searchsorted(spans, before + _PIECE, side="right")), low + 1)
            size = (end - begin)[low:high]
            head = np.cumsum(size) - size
            turn = np.arange(int(size.sum())) - np.repeat(head, size)
            in_trial = turn + np.repeat(self.first[item[low:high]] + begin[low:high], size)
            in_text = turn + np.repeat(first[row[low:high]] + begin[low:high] + shift[low:high], size)
            sums = np.concatenate([[0], np.cumsum(self.tokens[in_trial] == tokens[in_text])])
            wide = np.repeat(width[low:high], size)
            # Matches in the window that starts at each place, where it lies inside the alignment.
            stop = np.minimum(np.arange(len(turn)) + wide, len(turn))
            window = np.where(turn + wide <= np.repeat(size, size), sums[stop] - sums[:-1], 0)
            top = np.maximum.reduceat(window, head)
            matched = sums[head + size] - sums[head]
            for at in np.flatnonzero(100 * top >= MATCH_PERCENT * width[low:high]).tolist():
                pair = int(row[low + at]), int(item[low + at])
                new = (int(matched[at]), -int(begin[low + at] + shift[low + at]), int(size[at]))
                best[pair] = max(best.get(pair, new), new)
            low = high
        for (row, item), (matched, start, compared) in best.items():
            yield row, item, -start, compared, matched


def leaked_trials(executions: DataFrame, trials: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Executions that contain a trial's command line, or a passage of it, with few tokens changed.

    ``executions``: ``event_id, command_line``; ``trials``: ``trial_id, command_line``.  Returns
    ``event_id, trial_id, start, compared, matched``: for every leak the best alignment, from which
    token on, over how many tokens, and how many of them are equal.

    Tokens are runs of letters and digits in lower case, single characters in writing without
    spaces.  Fixed masks look at six of eleven
    consecutive tokens, so a changed token at an ignored place keeps the hash; trials under 13
    tokens have masks of their own that cover every allowed set of changed places.  Seeds of the
    executions meet those of the trials; around a hit both texts are compared token by token.
    It is a leak if in some window of 13 tokens (the whole trial, if shorter) at least 80 % are
    equal.

    The trials are the small side.  Their size is measured; texts of up to ``pass_bytes`` are sent
    to the workers at once, and larger sets are looked for in several passes, each with its share
    of trials.  The executions are never shuffled.

    Defined cases: null is empty; trials under five tokens match as exact token runs, trials without
    a token never; repeated executions and trials are each reported; null ids are kept;
    an empty table on either side gives no rows; other columns are ignored.
    """
    bound_batches(executions.sparkSession)
    executions = executions.select("event_id", "command_line")
    trials = trials.select("trial_id", F.coalesce("command_line", F.lit("")).alias("command_line"))
    schema = (
        f"event_id {executions.schema['event_id'].dataType.simpleString()}, "
        f"trial_id {trials.schema['trial_id'].dataType.simpleString()}, start bigint, compared bigint, matched bigint"
    )
    total = trials.agg(F.sum(F.octet_length("command_line") + 64)).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    out = None
    for number in range(passes):
        share = trials.where(F.pmod(F.xxhash64("command_line"), F.lit(passes)) == number).toArrow()
        table = share.combine_chunks()
        texts = table["command_line"].combine_chunks() if len(table) else pa.array([], pa.string())
        index = executions.sparkSession.sparkContext.broadcast(SeedIndex(table["trial_id"].to_pylist(), texts))
        kind = table.schema.field("trial_id").type

        def work(batches, index=index, kind=kind):
            held = index.value
            for block in blocks(batches, "command_line", BLOCK_TEXT):
                tokens, first = tokens_of(block.column("command_line"))
                found = sorted(held.verified(tokens, first))
                column = lambda i: pa.array([f[i] for f in found], pa.int64())
                yield pa.record_batch(
                    {
                        "event_id": block.column("event_id").take(column(0)),
                        "trial_id": pa.array([held.ids[f[1]] for f in found], kind),
                        "start": column(2),
                        "compared": column(3),
                        "matched": column(4),
                    }
                )

        part = executions.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    return out
