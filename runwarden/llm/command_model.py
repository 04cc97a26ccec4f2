"""Language model of command lines: a bigram trie in Elias-Fano levels, built and asked in Spark."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.elias_fano import EliasFano
from runwarden.llm.level_files import load, save
from runwarden.llm.text_blocks import blocks, mix, words_of
from runwarden.session import ensure_checkpoint_dir, materialize

BLOCK_TEXT = 8_000_000
ADDED = 0.1
DISCOUNT = 0.75
END = mix(np.array([0x0E0D], dtype=np.uint64))[0]  # stands for the end of a text


def _sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with one end per text, row bounds)."""
    words = words_of(texts)
    first = words.first + np.arange(len(words.first))
    tokens = np.full(first[-1] if len(first) else 0, END, dtype=np.uint64)
    keep = np.ones(len(tokens), dtype=bool)
    keep[first[1:] - 1] = False
    tokens[keep] = words.hashes()
    return tokens, first


def _packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, of four bytes where they fit."""
    steps = np.diff(values, prepend=np.uint64(0))
    small = len(values) == 0 or int(steps[1:].max(initial=0)) < 1 << 32
    head = values[:1].tobytes()
    return (b"\4" if small else b"\x08") + head + (steps[1:].astype(np.uint32) if small else steps[1:]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, np.uint64, 1, 1) if len(data) > 1 else np.zeros(0, np.uint64)
    steps = np.frombuffer(data, np.uint32 if data[0] == 4 else np.uint64, -1, 9) if len(data) > 9 else np.zeros(0, np.uint32)
    return np.cumsum(np.concatenate([first, steps.astype(np.uint64)]), dtype=np.uint64)


@dataclass
class CommandModel:
    """Folder of the levels, the first word id of every shard, and the totals."""

    folder: str
    shift: int
    bases: np.ndarray
    tokens: int
    texts: int

    @property
    def words(self) -> int:
        return int(self.bases[-1])

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted word hashes; -1 and 0 for unknown words."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shards = (hashes >> np.uint64(self.shift)).astype(np.int64)
        for shard, low, high in _runs(shards):
            if self.bases[shard + 1] == self.bases[shard]:
                continue
            level = load(self.folder, f"words-{shard}")
            place = EliasFano(level).find(hashes[low:high] & np.uint64((1 << self.shift) - 1))
            known = np.flatnonzero(place >= 0)
            ids[low + known] = place[known] + self.bases[shard]
            counts[low + known] = level["counts"][place[known]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of word ids, in any order; the start of a text has the id ``words``."""
        out = np.full(len(ids), self.texts, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        shards = np.searchsorted(self.bases, ids[order], side="right") - 1
        for shard, low, high in _runs(shards):
            if shard < len(self.bases) - 1:
                at = order[low:high]
                out[at] = load(self.folder, f"words-{shard}")["counts"][ids[at] - self.bases[shard]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADDED) / (self.tokens + ADDED * (self.words + 1))

    def shard_of(self, contexts: np.ndarray) -> np.ndarray:
        """Contexts go where their words are; the start of a text goes to the last shard."""
        return np.minimum(np.searchsorted(self.bases, contexts, side="right") - 1, len(self.bases) - 2)

    def pair_scores(self, contexts: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | context) of pairs sorted by context and word; unknown ids are -1.

        ``counts`` are those of the words.
        """
        single = self.unigram(counts)
        out = np.log10(single)
        known = np.flatnonzero(contexts >= 0)
        totals = self.counts_of(contexts[known])
        for shard, low, high in _runs(self.shard_of(contexts[known])):
            at = known[low:high]
            level = load(self.folder, f"pairs-{shard}")
            if not level["shape"][0]:
                continue
            local = contexts[at] - self.bases[shard]
            pointers = EliasFano({k[2:]: v for k, v in level.items() if k.startswith("p_")})
            followers = (pointers.access(local + 1) - pointers.access(local)).astype(np.int64)
            total = np.maximum(totals[low:high], 1)
            seen = followers > 0
            out[at[seen]] = np.log10(DISCOUNT * followers[seen] / total[seen] * single[at[seen]])
            ask = np.flatnonzero(seen & (words[at] >= 0))
            place = EliasFano(level).find(
                local[ask].astype(np.uint64) * np.uint64(self.words + 1) + words[at[ask]].astype(np.uint64)
            )
            hit = place >= 0
            out[at[ask[hit]]] = level["book"][level["codes"][place[hit]]]
        return out


def _runs(keys: np.ndarray):
    """(key, low, high) of the runs of equal keys."""
    if len(keys):
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            yield int(keys[low]), low, high


def _merged(batches, columns: tuple[str, str]):
    """(shard, values, counts) of the packed rows of one shard after the other."""
    now, held = None, []

    def done():
        values, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
        return now, values[starts], np.add.reduceat(counts, starts) if len(starts) else counts

    for batch in batches:
        for shard, values, counts in zip(batch["shard"].to_pylist(), *(batch[c].to_pylist() for c in columns), strict=True):
            if held and shard != now:
                yield done()
                held = []
            now = shard
            held.append((_unpacked(values), np.frombuffer(counts, np.uint32).astype(np.int64)))
    if held:
        yield done()


def _rows(shards, values, counts) -> pa.RecordBatch:
    return pa.record_batch(
        {"shard": pa.array(shards, pa.int32()), "values": pa.array(values, pa.binary()), "counts": pa.array(counts, pa.binary())}
    )


def build_model(training: DataFrame, folder: str) -> CommandModel:
    """Count the words and word pairs of ``command_line`` and write the levels of the trie.

    The first level has the word hashes of a shard and their counts.  The second has for every
    context (the word before, or the start of a text) its followers, made monotone by the place of
    the context, the pointers to them, and their smoothed probabilities as 8-bit codes.
    """
    spark = training.sparkSession
    training = training.select("command_line")
    bits = max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    shift, shards = 64 - bits, 1 << bits

    def words(batches):
        for block in blocks(batches, "command_line", BLOCK_TEXT):
            tokens, _ = _sequences(block.column("command_line"))
            values, counts = np.unique(tokens, return_counts=True)
            parts = list(_runs((values >> np.uint64(shift)).astype(np.int64)))
            packed = [_packed(values[a:b] & np.uint64((1 << shift) - 1)) for _, a, b in parts]
            yield _rows([p[0] for p in parts], packed, [counts[a:b].astype(np.uint32).tobytes() for _, a, b in parts])

    def word_level(batches):
        for shard, values, counts in _merged(batches, ("values", "counts")):
            save(folder, f"words-{shard}", EliasFano.build(values) | {"counts": counts})
            yield pa.record_batch(
                {"shard": pa.array([shard], pa.int32()), "words": pa.array([len(values)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())}
            )

    packed = "shard int, values binary, counts binary"
    counted = training.mapInArrow(words, packed).repartition("shard").sortWithinPartitions("shard")
    sizes = materialize(counted.mapInArrow(word_level, "shard int, words bigint, tokens bigint")).collect()
    per_shard = np.zeros(shards, dtype=np.int64)
    for row in sizes:  # one row for each shard
        per_shard[row["shard"]] = row["words"]
    bases = np.concatenate([[0], np.cumsum(per_shard)])
    model = CommandModel(folder, shift, bases, sum(r["tokens"] for r in sizes), training.count())

    def pairs(batches):
        for block in blocks(batches, "command_line", BLOCK_TEXT):
            contexts, followers, _, _ = _pairs(model, block.column("command_line"))
            order = np.argsort(contexts, kind="stable")
            contexts, followers = contexts[order], followers[order]
            found, values, counts = [], [], []
            for shard, a, b in _runs(model.shard_of(contexts)):
                keys = (contexts[a:b] - bases[shard]).astype(np.uint64) * np.uint64(model.words + 1)
                keys, number = np.unique(keys + followers[a:b].astype(np.uint64), return_counts=True)
                found.append(shard)
                values.append(_packed(keys))
                counts.append(number.astype(np.uint32).tobytes())
            yield _rows(found, values, counts)

    def pair_level(batches):
        for shard, keys, counts in _merged(batches, ("values", "counts")):
            local = (keys // np.uint64(model.words + 1)).astype(np.int64)
            words = (keys % np.uint64(model.words + 1)).astype(np.int64)
            size = int(bases[shard + 1] - bases[shard]) + 1
            starts = np.searchsorted(local, np.arange(size + 1))
            followers = np.diff(starts)[local]
            total = model.counts_of(local + bases[shard])
            single = model.unigram(model.counts_of(words))
            smoothed = (counts - DISCOUNT) / total + DISCOUNT * followers / total * single
            book, codes = _quantised(np.log10(smoothed))
            pointers = {f"p_{k}": v for k, v in EliasFano.build(starts).items()}
            save(folder, f"pairs-{shard}", EliasFano.build(keys) | pointers | {"book": book, "codes": codes})
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "pairs": pa.array([len(keys)], pa.int64())})

    counted = training.mapInArrow(pairs, packed).repartition("shard").sortWithinPartitions("shard")
    written = {r["shard"] for r in materialize(counted.mapInArrow(pair_level, "shard int, pairs bigint")).collect()}
    for shard in set(range(shards)) - written:  # shards without a context
        nothing = EliasFano.build(np.zeros(0, np.uint64))
        save(folder, f"pairs-{shard}", nothing | {f"p_{k}": v for k, v in nothing.items()} | {"book": np.zeros(1), "codes": np.zeros(0, np.uint8)})
    return model


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(book, codes): 256 bins of equal numbers of values, each with its mean."""
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257))) if len(values) else np.zeros(1)
    codes = np.clip(np.searchsorted(edges, values, side="right") - 1, 0, max(len(edges) - 2, 0))
    numbers = np.bincount(codes, minlength=256)
    book = np.bincount(codes, weights=values, minlength=256) / np.maximum(numbers, 1)
    return book, codes.astype(np.uint8)


def _pairs(model: CommandModel, texts: pa.Array):
    """(context ids, word ids, word counts, row bounds) of every token of a block."""
    tokens, first = _sequences(texts)
    distinct, inverse = np.unique(tokens, return_inverse=True)
    ids, counts = model.word_ids(distinct)
    words = ids[inverse]
    contexts = np.empty(len(words), dtype=np.int64)
    contexts[1:] = words[:-1]
    contexts[first[:-1]] = model.words  # the start of a text
    return contexts, words, counts[inverse], first


def score_command_lines(executions: DataFrame, training: DataFrame, folder: str | None = None) -> DataFrame:
    """log10 probability of every command line under a bigram model and under word frequencies.

    ``executions``: ``event_id, command_line``; ``training``: ``command_line``.  Returns ``event_id,
    n_tokens, n_known, train_tokens, base_score, score``.  Tokens are the lower-cased (A-Z) words
    of the whole text and one end.  ``base_score`` uses word counts with 0.1 added to each;
    ``score`` interpolates discounted pair frequencies with them, so both are distributions over
    the same words.

    Method: counts are gathered by shard of the word or context hash, and each shard becomes one
    file per level in ``folder`` (by default under the shared checkpoint folder): monotone word
    hashes, monotone pointers and followers in Elias-Fano form, and 8-bit quantised smoothed
    probabilities.  Scoring tasks map the files into memory and find the pairs of a block of texts
    by successor search relative to the context; a block asks for each distinct pair once.

    Words are told apart by 64-bit hashes.  Defined cases: null or blank text is one end token;
    without training texts all words are unknown; repeated rows and null ids are scored like any
    other; an empty table gives no rows; other columns are ignored.
    """
    executions = executions.select("event_id", "command_line")
    kind = executions.schema["event_id"].dataType.simpleString()
    folder = folder or f"{ensure_checkpoint_dir(executions.sparkSession)}/levels/{uuid.uuid4().hex}"
    model = build_model(training, folder)

    def work(batches):
        for block in blocks(batches, "command_line", BLOCK_TEXT):
            contexts, words, counts, first = _pairs(model, block.column("command_line"))
            order = np.lexsort((words, contexts))
            c, w = contexts[order], words[order]
            fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) if len(c) else np.zeros(0, bool)
            scores = model.pair_scores(c[fresh], w[fresh], counts[order][fresh])
            each = np.empty(len(words))
            each[order] = scores[np.cumsum(fresh) - 1]
            base = np.log10(model.unigram(counts))
            yield pa.record_batch(
                {
                    "event_id": block.column("event_id"),
                    "n_tokens": np.diff(first),
                    "n_known": np.add.reduceat((counts > 0).astype(np.int64), first[:-1]),
                    "train_tokens": np.full(len(first) - 1, model.tokens, dtype=np.int64),
                    "base_score": np.add.reduceat(base, first[:-1]),
                    "score": np.add.reduceat(each, first[:-1]),
                }
            )

    return executions.mapInArrow(
        work,
        f"event_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
