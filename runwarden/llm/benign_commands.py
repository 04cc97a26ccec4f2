"""Probability that a command line is benign: supervised subword embeddings."""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.sampling import bounded_sample
from runwarden.llm.text_blocks import Words, blocks, characters, grams, raw_bytes
from runwarden.session import bound_batches

ORDERS = range(2, 5)
BUCKETS = 1 << 17  # character n-grams, and as many again for words
DIMENSIONS = 8
SAMPLE_ROWS = 2500
BLOCK_TEXT = 500_000
FEATURE_RATE = 30.0  # step of a vector against the output's; a feature's share of a text is small
_SAME = np.arange(256, dtype=np.uint8)
_REPEAT = np.int32(BUCKETS)  # stands for a word that repeats the word before it


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row bounds): the words and character n-grams of every text, with repeats.

    A word equal to its predecessor is written as one mark, whatever word it is.
    """
    data, bounds = raw_bytes(texts)
    found, gram_ends = grams(*characters(data, bounds), ORDERS, BUCKETS)
    words = Words(data, bounds)
    whole = words.hashes(_SAME)
    hashed = (whole & np.uint64(BUCKETS - 1)).astype(np.int32) + np.int32(BUCKETS)
    if len(whole):
        again = np.concatenate([[False], whole[1:] == whole[:-1]])
        again[words.first[:-1][words.counts > 0]] = False
        hashed[again] = _REPEAT
    sizes = np.diff(gram_ends) + words.counts
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), dtype=np.int32)
    grams_of = np.diff(gram_ends)
    out[np.arange(len(found)) + np.repeat(ends[:-1] - gram_ends[:-1], grams_of)] = found
    shift = ends[:-1] + grams_of - words.first[:-1]
    out[np.arange(len(hashed)) + np.repeat(shift, words.counts)] = hashed
    return out, ends


def _softmax(values: np.ndarray) -> np.ndarray:
    shifted = np.exp(values - values.max())
    return shifted / shifted.sum()


@dataclass
class BenignModel:
    """Embeddings by bucket, output vectors and biases of the classes 0 and 1."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @property
    def margins(self) -> np.ndarray:
        """Share of each bucket in the difference of the two class scores.

        The mean of vectors meets a linear output, so the score of a text is the mean of these.
        """
        return self.vectors @ (self.output[1] - self.output[0])


def train_sgd(
    bags: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    epochs: int = 12,
    rate: float = 1.0,
    seed: int = 3,
) -> BenignModel:
    """Embeddings and softmax output by stochastic gradient descent, one text at a time.

    A bag is (buckets, shares): the share of a bucket among all features of the text.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.1, 0.1, (2 * BUCKETS, DIMENSIONS))
    output, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    steps, done = epochs * max(len(bags), 1), 0
    for _ in range(epochs):
        for item in rng.permutation(len(bags)):
            buckets, shares = bags[item]
            step = rate * (1 - done / steps)
            done += 1
            hidden = shares @ vectors[buckets]
            error = _softmax(output @ hidden + bias)
            error[labels[item]] -= 1
            back = error @ output
            output -= step * np.outer(error, hidden)
            bias -= step * error
            vectors[buckets] -= step * FEATURE_RATE * shares[:, None] * back
    return BenignModel(vectors, output, bias)


def fit_benign_model(training: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float] | None:
    """Margins and bias from ``command_line, benign`` (0 or 1), on at most ``sample_rows`` rows.

    The sample is fitted in one Spark task.  Only what scoring needs, one number for each
    bucket, comes to the driver and not the vectors, which are ``DIMENSIONS`` times as large.
    """
    bound_batches(training.sparkSession)
    training = training.select("command_line", F.col("benign").cast("int").alias("benign"))
    chosen = bounded_sample(training.where("benign IN (0, 1)"), "command_line", sample_rows)

    def bags(batches):
        for block in blocks(batches, "command_line", BLOCK_TEXT):
            found, ends = features(block.column("command_line"))
            pairs = [np.unique(found[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch(
                {
                    "benign": block.column("benign"),
                    "rank": block.column("rank"),
                    "buckets": pa.array([p[0].astype(np.int32).tobytes() for p in pairs], pa.binary()),
                    "counts": pa.array([p[1].astype(np.int32).tobytes() for p in pairs], pa.binary()),
                }
            )

    def fit(batches):
        labels, held = [], []
        for batch in batches:
            for label, buckets, counts in zip(*(batch[c].to_pylist() for c in ("benign", "buckets", "counts")), strict=True):
                count = np.frombuffer(counts, np.int32)
                if len(count):
                    labels.append(label)
                    held.append((np.frombuffer(buckets, np.int32), (count / count.sum()).astype(np.float32)))
        if held:
            model = train_sgd(held, np.array(labels))
            table = (model.margins, float(model.bias[1] - model.bias[0]))
            yield pa.record_batch({"model": pa.array([pickle.dumps(table)], pa.binary())})

    chosen = chosen.withColumn("rank", F.xxhash64("command_line"))
    made = chosen.mapInArrow(bags, "benign int, rank bigint, buckets binary, counts binary")
    fitted = made.repartition(1).sortWithinPartitions("benign", "rank").mapInArrow(fit, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else None


def score_benign(
    executions: DataFrame, training: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: Sequence[str] = ()
) -> DataFrame:
    """Probability that each command line is benign, learned from labelled command lines.

    ``executions``: ``event_id, command_line``; ``training``: ``command_line, benign`` (0 or 1).
    Returns ``event_id``, the columns named in ``carry``, ``score, predicted``; ``predicted`` is 1 for a score of at least 0.5.

    Method: every word and every character 2- to 4-gram has a learned vector in a hashed table;
    their mean over the whole text meets a softmax output.  Both are trained with numpy
    stochastic gradient descent on a sample of at most ``sample_rows`` rows.

    Defined cases: null is empty, and an empty text has the score of the output's bias alone;
    without a usable training row every score is 0.5; labels other than 0 and 1 are not used;
    repeated rows, null ids and long texts are treated like any other; an empty table gives
    no rows; columns not in ``carry`` are ignored.
    """
    model = fit_benign_model(training, sample_rows)
    executions = executions.select("event_id", "command_line", *[c for c in carry if c != "command_line"])
    fields = ", ".join(f"`{c}` {executions.schema[c].dataType.simpleString()}" for c in ("event_id", *carry))
    # Its size is fixed by BUCKETS.
    shared = executions.sparkSession.sparkContext.broadcast(model or (np.zeros(2 * BUCKETS), 0.0))

    def work(batches):
        margins, bias = shared.value
        for block in blocks(batches, "command_line", BLOCK_TEXT):
            found, ends = features(block.column("command_line"))
            sizes = np.diff(ends)
            sums = np.zeros(len(sizes))
            full = np.flatnonzero(sizes)
            if len(full):
                sums[full] = np.add.reduceat(margins[found], ends[:-1][full])
            logit = sums / np.maximum(sizes, 1) + bias
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.record_batch(
                {
                    **{c: block.column(c) for c in ("event_id", *carry)},
                    "score": score,
                    "predicted": (score >= 0.5).astype(np.int32),
                }
            )

    return executions.mapInArrow(work, f"{fields}, score double, predicted int")
