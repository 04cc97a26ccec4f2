"""Byte-pair token ids of command lines by walks over tries of their distinct words."""

from __future__ import annotations

import json
import threading
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType

from runwarden.llm.text_blocks import blocks
from runwarden.llm.token_counts import PreTokenizer

BLOCK_TEXT = 4_000_000
#: Words whose ids a task keeps from one block to the next; more are computed again.
KEPT_WORDS = 120_000
_PIECE = 1_000_000
_KNOWN_PAIRS = 200_000
_NEVER = 1 << 62
#: First character of an added token among the words of a block; no word holds white space.
_ADDED = "\n"
_LOADED = threading.local()


def _held(kind, path: str):
    held = _LOADED.__dict__.setdefault("held", {})
    if (kind, path) not in held:
        held[kind, path] = kind(path)
    return held[kind, path]


class WordCutter(PreTokenizer):
    """Cuts a text into its pre-tokens in order; added tokens stand in between."""

    def sequence(self, text: str) -> Iterator[list[str] | str]:
        """Lists of pre-tokens, and each added token found between them as a plain string."""
        if self.special is None or self.special.search(text) is None:
            yield self._cut(text)
            return
        at = 0
        for found in self.special.finditer(text):
            yield self._cut(text[at : found.start()])
            yield found.group()
            at = found.end()
        yield self._cut(text[at:])


def _byte_of_character() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class LastTokens:
    """Which token is the last one of an encoded prefix, and so the whole encoding.

    The encoding of a prefix is that of a shorter prefix and one more token.  The last token
    is the one suffix of the prefix that is a token, keeps its shape on its own, and keeps
    its border to the last token of what comes before; there is exactly one.
    A border breaks when, at some time, the symbols at both sides of it form a pair that is
    merged earlier than either of them is merged on its other side (of equal pairs the left one
    goes first).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        suffix = model.get("end_of_word_suffix") or ""
        unsupported = [k for k in ("continuing_subword_prefix", "dropout", "unk_token") if model.get(k)]
        if model["type"] != "BPE" or unsupported or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("only a plain byte-level pair encoding is supported")
        vocabulary, of_character = model["vocab"], _byte_of_character()
        count = max(vocabulary.values()) + 1
        self.text: list[bytes | None] = [None] * count
        ends = [False] * count
        for character, byte in of_character.items():
            for name, end in {(character, not suffix), (character + suffix, True)}:
                token = vocabulary[name]
                self.text[token], ends[token] = bytes([byte]), end
        self.rank = [-1] * count
        # Symbols at the left and right edge of a token while it grows, and whether it keeps its shape.
        self.left = [(t,) for t in range(count)]
        self.right = [(t,) for t in range(count)]
        whole = [t is not None for t in self.text]
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, token = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.text[a] is None or self.text[b] is None or self.text[token] is not None:
                raise ValueError(f"merge {rank} does not make a new token of known ones")
            self.pairs[a << 24 | b] = rank
            self.text[token], ends[token], self.rank[token] = self.text[a] + self.text[b], ends[b], rank
            self.left[token], self.right[token] = (*self.left[a], token), (*self.right[b], token)
            whole[token] = whole[a] and whole[b] and self._border_holds(a, b, rank)
        self.width = [len(t or b"") for t in self.text]
        # Tokens by their bytes, inside a word and at its end, and the sizes that end in a byte.
        self.inside = {self.text[t]: t for t in range(count) if whole[t] and not (suffix and ends[t])}
        self.at_end = {self.text[t]: t for t in range(count) if whole[t] and ends[t]}
        self.inside_sizes, self.at_end_sizes = self._sizes(self.inside), self._sizes(self.at_end)
        self.known: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}

    @staticmethod
    def _sizes(tokens: dict[bytes, int]) -> list[list[list[int]]]:
        """For each last byte and depth the sizes of tokens that fit, longest first."""
        sizes: list[set[int]] = [set() for _ in range(256)]
        for text in tokens:
            sizes[text[-1]].add(len(text))
        return [[sorted((x for x in s if x <= d), reverse=True) for d in range(max(s, default=0) + 1)] for s in sizes]

    def _border_holds(self, first: int, second: int, until: int = _NEVER) -> bool:
        """Whether no merge before ``until`` crosses the border between two tokens."""
        right, left, rank = self.right[first], self.left[second], self.rank
        for i, a in enumerate(right):
            a_goes = rank[right[i + 1]] if i + 1 < len(right) else until
            for j, b in enumerate(left):
                merged = self.pairs.get(a << 24 | b)
                if merged is not None and merged < a_goes:
                    b_goes = rank[left[j + 1]] if j + 1 < len(left) else until
                    if merged <= b_goes:
                        return False
        return True

    def last(self, word: bytes, depth: int, last: list[int], tokens: dict[bytes, int], sizes: list[list[list[int]]]) -> int:
        by_depth = sizes[word[depth - 1]]
        for size in by_depth[depth] if depth < len(by_depth) else by_depth[-1]:
            token = tokens.get(word[depth - size : depth])
            if token is None:
                continue
            if size == depth:
                return token
            key = last[depth - size] << 24 | token
            holds = self.known.get(key)
            if holds is None:
                if len(self.known) >= _KNOWN_PAIRS:
                    self.known.clear()
                holds = self.known[key] = self._border_holds(last[depth - size], token)
            if holds:
                return token
        raise AssertionError("a single byte is a token")


class TrieWalk:
    """Token ids of words that come in sorted order.

    Sorted words are the leaves of a trie in depth-first order.  The walk keeps the last token of
    every prefix on the way to the present leaf; what a word shares with the one before it is not
    computed again.
    """

    def __init__(self, tokens: LastTokens):
        self.tokens = tokens
        self.word, self.last, self.found = b"", [-1], []

    def ids(self, word: bytes) -> list[int]:
        if word == self.word:
            return self.found
        tokens, last, before = self.tokens, self.last, self.word
        # The final symbol of a word is another one than the same byte inside a word.
        shared, most = 0, min(len(before), len(word)) - 1
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del last[shared + 1 :]
        for depth in range(shared + 1, len(word)):
            last.append(tokens.last(word, depth, last, tokens.inside, tokens.inside_sizes))
        token, depth = tokens.last(word, len(word), last, tokens.at_end, tokens.at_end_sizes), len(word)
        found = [token]
        while depth := depth - tokens.width[token]:
            token = last[depth]
            found.append(token)
        found.reverse()
        self.word, self.found = word, found
        return found


class _Places(dict):
    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers ``start[i] .. start[i] + size[i] - 1``, one span after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    large = pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data)],
    )
    return large.cast(pa.binary())


def encode_command_lines(executions: DataFrame, tokenizer_file: str) -> DataFrame:
    """Token ids of every whole command line, as the library gives them for ``tokenizer_file``.

    ``executions``: ``event_id`` (any type), ``command_line``; ``tokenizer_file``: JSON file of a
    byte-level pair encoding within pre-tokens, readable on every worker.  No begin, end or
    other added tokens are put in, none is cut off; those found in a text are one id each.
    Returns ``event_id, n_tokens, ids``; ``ids`` are little-endian unsigned 32-bit integers, the form
    of training shards.

    Method: a task cuts its texts into words, a block of some megabytes at a time, and sorts the
    distinct words of the block, which lays them out as a trie in depth-first order.  A walk over
    it carries the last token of each prefix, so the encoding of a shared prefix is computed
    once; words of earlier blocks are known already.  The texts are then put together from the ids of
    their words.  Nothing is shuffled or kept between tasks.

    Defined cases: null is empty and has no tokens; rows are encoded one by one, so repeated
    rows and null ids stay as they are; a text longer than a block is a block of its own; an
    empty table gives no rows; other columns are ignored.
    """
    executions = executions.select("event_id", "command_line")
    kind = executions.schema["event_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def work(batches):
        cutter, tokens = _held(WordCutter, tokenizer_file), _held(LastTokens, tokenizer_file)
        known: dict[str, bytes] = {}
        for block in blocks(batches, "command_line", BLOCK_TEXT):
            places, held, ends = _Places(), array("i"), [0]
            for text in (value.as_py() for value in block.column("command_line")):
                for part in cutter.sequence(text or ""):
                    if isinstance(part, str):
                        held.append(places[f"{_ADDED}{part}"])
                    else:
                        held.extend(map(places.__getitem__, part))
                ends.append(len(held))
            fresh = [word for word in places if word not in known]
            walk = TrieWalk(tokens)
            for name in sorted((w.encode() for w in fresh if w[0] != _ADDED)):
                known[name.decode()] = array("I", walk.ids(name)).tobytes()
            known |= {w: array("I", [tokens.special[w[1:]]]).tobytes() for w in fresh if w[0] == _ADDED}
            found = [known[word] for word in places]
            if len(known) > KEPT_WORDS:
                known = dict(zip(places, found)) if len(places) <= KEPT_WORDS else {}
            ids, bounds = _put_together(held, np.array(ends), found)
            yield pa.record_batch(
                {
                    "event_id": block.column("event_id").cast(arrow_kind),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids": _binary(ids, bounds * 4),
                }
            )

    return executions.mapInArrow(work, f"event_id {kind.simpleString()}, n_tokens bigint, ids binary")


def _put_together(held: array, ends: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, bounds) from the places of their words and the ids of the words."""
    places = np.frombuffer(held, np.int32)
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4")
    sums = np.concatenate([[0], np.cumsum(size[places])])
    ids = np.empty(int(sums[-1]), dtype="<u4")
    for low in range(0, len(places), _PIECE):
        some = places[low : low + _PIECE]
        ids[sums[low] : sums[low + len(some)]] = pool[_spans(start[some], size[some])]
    return ids, sums[ends]


def decode_command_lines(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """Text of every row of token ids, as the library's own decoding gives it, added tokens included.

    ``encoded``: ``event_id`` (any type), ``ids`` as ``encode_command_lines`` returns them, and any other
    columns, which stay.  Adds ``command_line``.  A file without a decoder joins its tokens by one
    space, as the library does.  Rows are independent; unknown ids are left out, null gives null,
    no ids give an empty text.
    """
    schema = StructType([f for f in encoded.schema.fields if f.name != "command_line"]).add("command_line", StringType())

    def work(batches):
        names = _names(tokenizer_file)
        known = len(names)
        for batch in batches:
            texts = []
            for value in batch["ids"]:
                data = value.as_buffer()
                if data is None:
                    texts.append(None)
                    continue
                ids = np.frombuffer(data, "<u4")
                if len(ids) and int(ids.max()) >= known:
                    ids = ids[ids < known]
                texts.append(" ".join([n for n in map(names.__getitem__, ids.tolist()) if n is not None]))
            columns = {n: batch[n] for n in batch.schema.names if n != "command_line"}
            yield pa.record_batch(columns | {"command_line": pa.array(texts, pa.string())})

    return encoded.mapInArrow(work, schema)


def _names(path: str) -> list[str | None]:
    """Name of every token id."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    if config.get("decoder") is not None:
        raise ValueError("only files without a decoder are supported")
    names = {i: t for t, i in config["model"]["vocab"].items()} | {t["id"]: t["content"] for t in config["added_tokens"]}
    return [names.get(i) for i in range(max(names) + 1)]
