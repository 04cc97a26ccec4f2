"""Token counts of command lines without token ids."""

from __future__ import annotations

import json
import os
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.text_blocks import blocks, raw_bytes
from runwarden.session import materialize

BLOCK_TEXT = 8_000_000
#: Below this code point composing is the identity and lower-casing looks at one character only.
_PLAIN = regex.compile(r"[^\u0000-˿]")
_LOADED = threading.local()


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers as differences, byte plane by byte plane, compressed."""
    steps = np.diff(values.astype(np.int32), prepend=np.int32(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _restored(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int32).ravel(), dtype=np.int32)


class PreTokenizer:
    """Cuts texts into the pre-tokens of a tokenizer file whose added tokens are not normalised."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        special = [t["content"] for t in config["added_tokens"]]
        for token in config["added_tokens"]:
            if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"added token {token['content']!r} has rules that are not supported")
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = self._plain_pattern(config)

    @staticmethod
    def _plain_pattern(config: dict):
        """Pattern that gives the pre-tokens of lower-cased plain texts, if the file's steps allow one."""
        normalizer = config.get("normalizer") or {}
        steps = [n["type"] for n in normalizer.get("normalizers", [])]
        cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or normalizer["normalizers"][1]["pattern"] != {"Regex": "\\s+"}:
            return None
        if [c["type"] for c in cuts] != ["Split", "ByteLevel"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"]:
            return None
        split = cuts[0]
        if split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"]:
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _cut(self, text: str) -> list[str]:
        if self.pattern is not None and _PLAIN.search(text) is None:
            return self.pattern.findall(text.lower())
        plain = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [plain[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def counts(self, text: str) -> tuple[Counter, int]:
        """Frequency of every pre-token and the number of added tokens in the text."""
        if self.special is None or self.special.search(text) is None:
            return Counter(self._cut(text)), 0
        found, parts = Counter(), self.special.split(text)
        for part in parts:
            found.update(self._cut(part))
        return found, len(parts) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


def _loaded(path: str) -> PreTokenizer:
    held = _LOADED.__dict__.setdefault("held", {})
    if path not in held:
        held[path] = PreTokenizer(path)
    return held[path]


def _token_blocks(executions: DataFrame, path: str) -> DataFrame:
    """A row per block of texts: its ids and sizes, its pre-tokens, and who has which how often.

    ``held`` lists for text after text the places of its pre-tokens in ``tokens``; ``times`` has
    one byte each, so a pre-token found more than 255 times is listed again.  All three are
    compressed.
    """
    kind = executions.schema["event_id"].dataType.simpleString()

    def work(batches):
        cutter, partition, number = _loaded(path), TaskContext.get().partitionId(), 0
        for block in blocks(batches, "command_line", BLOCK_TEXT):
            texts = block.column("command_line")
            places: dict[str, int] = {}
            held, times, ends, added = [], [], [0], []
            for text in texts.to_pylist():
                found, special = cutter.counts(text or "")
                added.append(special)
                placed = sorted((places.setdefault(t, len(places)), n) for t, n in found.items())
                for place, count in placed:
                    while count > 255:
                        held.append(place)
                        times.append(255)
                        count -= 255
                    held.append(place)
                    times.append(count)
                ends.append(len(held))
            yield pa.record_batch(
                {
                    "block": pa.array([(partition << 24) + number], pa.int64()),
                    "event_ids": pa.array([block.column("event_id").to_pylist()], pa.list_(block.column("event_id").type)),
                    "bytes": pa.array([np.diff(raw_bytes(texts)[1])], pa.list_(pa.int64())),
                    "added": pa.array([added], pa.list_(pa.int64())),
                    "ends": pa.array([ends], pa.list_(pa.int64())),
                    "held": pa.array([_squeezed(np.array(held, np.int32))], pa.binary()),
                    "times": pa.array([zstandard.compress(bytes(times), 1)], pa.binary()),
                    "tokens": pa.array([zstandard.compress("\n".join(places).encode(), 1)], pa.binary()),
                }
            )
            number += 1

    return executions.mapInArrow(
        work,
        f"block bigint, event_ids array<{kind}>, bytes array<bigint>, added array<bigint>, "
        "ends array<bigint>, held binary, times binary, tokens binary",
    )


def _pieces_of_blocks(cut: DataFrame, path: str) -> DataFrame:
    """(block, places, pieces): pieces of every pre-token, each distinct one counted once.

    Pre-tokens are dealt by hash into as many ranges as there are shuffle partitions.  A range
    has a pre-token at most once from each block, so a frequent one weighs no more than others.
    """
    ranges = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        import zlib

        for batch in batches:
            for block, joined in zip(batch["block"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                joined = zstandard.decompress(joined).decode()
                tokens = joined.split("\n") if joined else []
                ranks = np.array([zlib.crc32(t.encode()) % ranges for t in tokens], dtype=np.int64)
                order = np.argsort(ranks, kind="stable")
                keys, starts = np.unique(ranks[order], return_index=True)
                parts = np.split(order, starts[1:]) if len(order) else []
                yield pa.record_batch(
                    {
                        "range": pa.array(keys.astype(np.int32)),
                        "block": pa.array([block] * len(keys), pa.int64()),
                        "places": pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary()),
                        "tokens": pa.array(["\n".join([tokens[i] for i in p]) for p in parts], pa.string()),
                    }
                )

    def count(batches):
        counter, now, known = _loaded(path), None, {}
        for batch in batches:
            sizes = []
            for key, joined in zip(batch["range"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                if key != now:
                    now, known = key, {}
                tokens = joined.split("\n")
                fresh = [t for t in tokens if t not in known]
                known.update(zip(fresh, counter.pieces(fresh), strict=True))
                sizes.append(np.array([known[t] for t in tokens], np.int32).tobytes())
            yield pa.record_batch(
                {"block": batch["block"], "places": batch["places"], "pieces": pa.array(sizes, pa.binary())}
            )

    dealt = cut.select("block", "tokens").mapInArrow(deal, "range int, block bigint, places binary, tokens string")
    together = dealt.repartition("range").sortWithinPartitions("range")
    return together.mapInArrow(count, "block bigint, places binary, pieces binary")


def count_tokens(executions: DataFrame, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole command line, as the library counts them for ``tokenizer_file``.

    ``executions``: ``event_id, command_line``; ``tokenizer_file``: JSON file of a byte-pair
    encoding that works within pre-tokens, readable on every worker.  Returns ``event_id,
    n_bytes, n_tokens, over_limit``.  Added tokens found in a text count one each.

    Method: texts are cut into pre-tokens once, in blocks of a few megabytes; every distinct
    pre-token of the whole table is tokenised once; its number of pieces goes back to the
    blocks that have it, where it meets the frequencies of each text.  No ids are kept.

    Defined cases: null is empty and has 0 tokens; rows are counted one by one, so repeated
    rows and null ids stay as they are; an empty table gives no rows; other columns are ignored.
    """
    executions = executions.select("event_id", "command_line")
    kind = executions.schema["event_id"].dataType.simpleString()
    cut = materialize(_token_blocks(executions, tokenizer_file))
    pieces = materialize(_pieces_of_blocks(cut, tokenizer_file))
    parts = pieces.groupBy("block").agg(F.collect_list(F.struct("places", "pieces")).alias("parts"))

    def add_up(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = row["parts"] or []
                sizes = np.zeros(sum(len(p["places"]) // 4 for p in parts), dtype=np.int64)
                for part in parts:
                    sizes[np.frombuffer(part["places"], np.int32)] = np.frombuffer(part["pieces"], np.int32)
                held = _restored(row["held"])
                tokens = sizes[held] * np.frombuffer(zstandard.decompress(row["times"]), np.uint8)
                sums = np.concatenate([[0], np.cumsum(tokens)])[np.array(row["ends"])]
                total = np.diff(sums) + np.array(row["added"], np.int64)
                yield pa.record_batch(
                    {
                        "event_id": pa.array(row["event_ids"], schema_type),
                        "n_bytes": pa.array(row["bytes"], pa.int64()),
                        "n_tokens": total,
                        "over_limit": total > limit,
                    }
                )

    from pyspark.sql.pandas.types import to_arrow_type

    schema_type = to_arrow_type(executions.schema["event_id"].dataType)
    joined = cut.drop("tokens").join(parts, "block", "left")
    return joined.mapInArrow(add_up, f"event_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
