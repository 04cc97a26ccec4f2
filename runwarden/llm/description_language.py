"""Language of finding descriptions: sparse logistic regression on character n-grams."""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.sampling import bounded_sample
from runwarden.llm.text_blocks import blocks, characters, grams, raw_bytes
from runwarden.session import bound_batches

UNKNOWN = "und"
ORDERS = range(1, 4)
BUCKETS = 1 << 15
SAMPLE_ROWS = 3000
BLOCK_TEXT = 500_000


def _lower_letters() -> np.ndarray:
    """For every character of the basic plane its lower-case letter, or 0 for other characters."""
    table = np.zeros(1 << 16, dtype=np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_LETTERS: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_lower_letters())
    out = _LETTERS[0][np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        out[high] = [c if chr(c).isalpha() else 0 for c in codes[high].tolist()]
    return out


def term_counts(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per text the buckets it has, their counts, and whether it has a letter.

    Letters are lower-cased; every run of other characters counts as one space.
    """
    codes, bounds = characters(*raw_bytes(texts))
    low = _letters(codes)
    letter = low > 0
    keep = letter.copy()
    if len(keep):
        keep[1:] |= letter[:-1]  # the first of a run of other characters stays
    sums = np.concatenate([[0], np.cumsum(keep)])
    have = np.concatenate([[0], np.cumsum(letter)])
    hashed, ends = grams(np.where(low == 0, 32, low)[keep], sums[bounds], ORDERS, BUCKETS)
    terms, counts = [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > BUCKETS // 8:
            full = np.bincount(hashed[a:b], minlength=BUCKETS)
            found = np.flatnonzero(full)
            terms.append(found)
            counts.append(full[found])
        else:
            found, number = np.unique(hashed[a:b], return_counts=True)
            terms.append(found)
            counts.append(number)
    return terms, counts, np.diff(have[bounds]) > 0


@dataclass
class LanguageModel:
    """Weights by class and bucket, inverse document frequencies and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((values * values).sum())
        return values / norm if norm > 0 else values

    def logits(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weights[:, terms] @ self.vector(terms, counts) + self.bias


def _softmax(values: np.ndarray) -> np.ndarray:
    shifted = np.exp(values - values.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def train_ftrl(
    vectors: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    classes: int,
    buckets: int = BUCKETS,
    epochs: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.01,
    l2: float = 0.01,
) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial weights by follow-the-regularised-leader with elastic-net penalties.

    Every coordinate keeps the sum of gradients z and of their squares n.  Its weight is 0
    while |z| <= l1, and else -(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2).
    """
    z = np.zeros((classes, buckets + 1))
    n = np.zeros((classes, buckets + 1))

    def weights(at):
        zz, nn = z[:, at], n[:, at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(nn)) / alpha + l2)

    for epoch in range(epochs):
        for item in np.random.default_rng(epoch).permutation(len(vectors)):
            terms, values = vectors[item]
            at, x = np.append(terms, buckets), np.append(values, 1.0)
            w = weights(at)
            error = _softmax(w @ x)
            error[labels[item]] -= 1.0
            gradient = error[:, None] * x[None, :]
            old = n[:, at]
            new = old + gradient * gradient
            z[:, at] += gradient - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[:, at] = new
    final = weights(np.arange(buckets + 1))
    return final[:, :-1], final[:, -1]


def calibrate_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the least negative log likelihood, by golden-section search."""

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def _train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> LanguageModel:
    """Model from ordered rows of language, terms and counts; one row in five only calibrates."""
    languages = sorted({r[0] for r in rows})
    model = LanguageModel(languages, idf, np.zeros((len(languages), BUCKETS)), np.zeros(len(languages)), 1.0)
    vectors = [(terms, model.vector(terms, counts)) for _, terms, counts in rows]
    labels = np.array([languages.index(r[0]) for r in rows])
    held = np.arange(len(rows)) % 5 == 4
    if held.sum() < 5:
        held[:] = False
    model.weights, model.bias = train_ftrl(
        [v for v, h in zip(vectors, held, strict=True) if not h], labels[~held], len(languages)
    )
    if held.any():
        logits = np.array([model.weights[:, t] @ x + model.bias for (t, x), h in zip(vectors, held, strict=True) if h])
        model.temperature = calibrate_temperature(logits, labels[held])
    return model


def fit_language_model(training: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Model from ``description, language``; None without a labelled row.

    Inverse document frequencies come from all rows.  The weights are fitted on at most
    ``sample_rows`` rows over all languages in equal shares, of which one in five only sets
    the temperature; fewer than 25 rows all train and the temperature stays 1.  Features are made
    in Spark tasks and the sample is fitted in one of them; only the model, whose size is that
    of the languages times ``BUCKETS``, comes to the driver.
    """
    bound_batches(training.sparkSession)
    training = training.select("description", "language").where("language IS NOT NULL")

    def frequencies(batches):
        seen, texts = np.zeros(BUCKETS, dtype=np.int64), 0
        for block in blocks(batches, "description", BLOCK_TEXT):
            terms, _, _ = term_counts(block.column("description"))
            texts += len(terms)
            if terms:
                seen += np.bincount(np.concatenate(terms), minlength=BUCKETS)
        yield pa.record_batch({"bucket": pa.array(np.arange(BUCKETS + 1)), "texts": np.append(seen, texts)})

    counted = training.mapInArrow(frequencies, "bucket bigint, texts bigint")
    table = counted.groupBy("bucket").agg(F.sum("texts").alias("texts")).toArrow()  # BUCKETS + 1 rows
    texts = np.zeros(BUCKETS + 1)
    texts[table["bucket"].to_numpy()] = table["texts"].to_numpy()
    idf = np.log((1 + texts[-1]) / (1 + texts[:-1])) + 1

    def features(batches):
        for block in blocks(batches, "description", BLOCK_TEXT):
            terms, counts, _ = term_counts(block.column("description"))
            yield pa.record_batch(
                {
                    "language": block.column("language"),
                    "rank": block.column("rank"),
                    "terms": pa.array([t.astype(np.int32).tobytes() for t in terms], pa.binary()),
                    "counts": pa.array([c.astype(np.int32).tobytes() for c in counts], pa.binary()),
                }
            )

    def fit(batches):
        rows = [
            (language, np.frombuffer(terms, np.int32), np.frombuffer(counts, np.int32))
            for batch in batches
            for language, terms, counts in zip(*(batch[c].to_pylist() for c in ("language", "terms", "counts")), strict=True)
        ]
        if rows:
            yield pa.record_batch({"model": pa.array([pickle.dumps(_train(rows, idf))], pa.binary())})

    chosen = bounded_sample(training, "description", sample_rows, by="language")
    chosen = chosen.withColumn("rank", F.xxhash64("description"))
    made = chosen.mapInArrow(features, "language string, rank bigint, terms binary, counts binary")
    fitted = made.repartition(1).sortWithinPartitions("language", "rank").mapInArrow(fit, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else None


def identify_language(
    findings: DataFrame, training: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: Sequence[str] = ()
) -> DataFrame:
    """Language of every finding's description with a calibrated probability.

    ``findings``: ``finding_id, description``; ``training``: ``description, language``.
    Returns ``finding_id``, the columns named in ``carry``,
    ``language, score``.

    Method: hashed character 1- to 3-grams weighted by (1 + ln tf) idf and scaled to length 1,
    multinomial logistic regression trained with follow-the-regularised-leader and elastic-net
    penalties, then temperature calibration on rows the weights have not seen.  Only the text
    decides.

    Defined cases: a null, empty or letterless description is ``und`` with score 0, and so is
    every row when no training row has a language; ties go to the first language by code
    point; repeated rows, null ids and long texts are treated like any other; an empty table
    gives no rows; columns not in ``carry`` are ignored.
    """
    model = fit_language_model(training, sample_rows)
    findings = findings.select("finding_id", "description", *[c for c in carry if c != "description"])
    fields = ", ".join(f"`{c}` {findings.schema[c].dataType.simpleString()}" for c in ("finding_id", *carry))
    # The model's size is fixed by BUCKETS and the number of languages.
    shared = findings.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        for block in blocks(batches, "description", BLOCK_TEXT):
            terms, counts, lettered = term_counts(block.column("description"))
            languages, scores = [], []
            for term, count, known in zip(terms, counts, lettered.tolist(), strict=True):
                if model is None or not known:
                    languages.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _softmax(model.logits(term, count) / model.temperature)
                best = int(p.argmax())
                languages.append(model.languages[best])
                scores.append(float(p[best]))
            yield pa.record_batch(
                {
                    **{c: block.column(c) for c in ("finding_id", *carry)},
                    "language": pa.array(languages, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                }
            )

    return findings.mapInArrow(predict, f"{fields}, language string, score double")
