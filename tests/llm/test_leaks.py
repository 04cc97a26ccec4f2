"""Leaked trials against an alignment of every trial with every text at every shift, in plain Python."""

import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runwarden.llm import text_blocks, trial_leaks
from runwarden.llm.trial_leaks import MATCH_PERCENT, UNSPACED, WINDOW, leaked_trials


def words(text):
    """Tokens by the definition: runs of letters, digits and marks; characters where writing has no spaces."""
    out, run = [], ""
    for char in text or "":
        inside = char.isalnum() or unicodedata.category(char)[0] == "M"
        alone = inside and any(a <= ord(char) <= b for a, b in UNSPACED)
        if not inside or alone:
            out += [run] if run else []
            run = ""
        if alone:
            out.append(char)
        elif inside:
            run += char.lower() if len(char.lower()) == 1 else char
    return out + ([run] if run else [])


def best_alignment(text, trial):
    """(matched, start, compared) of the best shift that leaks, or None."""
    found, width = None, min(WINDOW, len(trial))
    for shift in range(-len(trial), len(text) + 1) if trial else ():
        begin, end = max(0, -shift), min(len(trial), len(text) - shift)
        if end - begin < width:
            continue
        equal = [trial[i] == text[i + shift] for i in range(begin, end)]
        if max(sum(equal[i : i + width]) for i in range(len(equal) - width + 1)) * 100 >= MATCH_PERCENT * width:
            new = (sum(equal), -(begin + shift), end - begin)
            found = max(found or new, new)
    return found and (found[0], -found[1], found[2])


def changed(rng, tokens, count):
    out = list(tokens)
    for place in rng.sample(range(len(out)), min(count, len(out))):
        out[place] = rng.choice(["zzz", "Q9", "—"])
    return out


def test_leaks_equal_all_alignments(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "Straße", "don’t", "数", "据", "x"]
    trials = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 7, 9, 10, 11, 12, 13, 14, 30]))) for _ in range(40)]
    trials += ["a b " * 12, "same " * 20, "数据库在此处存储所有的记录并且每天备份", "", None, trials[0]]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(60)]
    for i in range(160):
        tokens = (rng.choice(trials) or "").split()
        low = rng.randrange(len(tokens)) if tokens and i % 3 == 0 else 0
        middle = changed(rng, tokens[low:], rng.randrange(0, 5))
        texts.append(" ".join([*rng.choices(vocabulary, k=rng.randrange(20)), *middle, *rng.choices(vocabulary, k=rng.randrange(20))]))
    texts += ["a b " * 30, "same " * 50, "“数据库在此处存储,所有的记录并且每天备份”", "", None, texts[0]]
    events = spark.createDataFrame(list(enumerate(texts)), "event_id int, command_line string")
    held = spark.createDataFrame(list(enumerate(trials)), "trial_id int, command_line string")
    for size in (10**6, 1500):  # all trials at once, and in several passes
        found = leaked_trials(events, held, pass_bytes=size).collect()
        got = {(r.event_id, r.trial_id): (r.matched, r.start, r.compared) for r in found}
        assert len(got) == len(found)
        want = {}
        for i, text in enumerate(texts):
            for j, trial in enumerate(trials):
                best = best_alignment(words(text), words(trial))
                # A trial under five tokens leaks as an exact run, which its whole width asks for.
                if best:
                    want[i, j] = best
        assert got.keys() == want.keys()
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(want) > 100


def test_characters_decoded_in_pieces(monkeypatch):
    rng = random.Random(5)
    rows = ["".join(rng.choices("aZ é\n数\U0001f600́", k=rng.randrange(12))) for _ in range(60)] + ["", "数"]
    coded = [r.encode() for r in rows]
    data = np.frombuffer(b"".join(coded), np.uint8)
    bounds = np.cumsum([0] + [len(r) for r in coded])
    for piece in (1, 2, 3, 5, 64, 1 << 18):
        monkeypatch.setattr(text_blocks, "_PIECE_BYTES", piece)
        codes, ends = text_blocks.characters(data, bounds)
        assert codes.tolist() == [ord(c) for r in rows for c in r]
        assert np.diff(ends).tolist() == [len(r) for r in rows] and ends[0] == 0


def test_memory_of_a_block_of_texts():
    """A worker needs little more than the text, its code points and the kinds of characters."""
    trial_leaks.tokens_of(pa.array(["a"]))  # builds the tables
    texts = pa.array(["Straße 数据 of some plain words, " * 60] * 1500)
    tracemalloc.start()
    try:
        trial_leaks.tokens_of(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 25 * texts.nbytes, most / texts.nbytes


def test_leaks_hand_over_small_batches(spark):
    line = F.concat(F.lit("select name from users "), F.repeat(F.lit("some other words "), 200))
    events = spark.range(0, 4000, numPartitions=1).select(F.col("id").alias("event_id"), line.alias("command_line"))
    trials = spark.createDataFrame([(1, "select name from users")], "trial_id int, command_line string")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(1 << 26))
    try:
        assert leaked_trials(events, trials).count() == 4000

        def sizes(batches):
            for batch in batches:
                yield pa.record_batch({"bytes": pa.array([batch.nbytes], pa.int64())})

        assert max(r[0] for r in events.mapInArrow(sizes, "bytes bigint").collect()) < 4_000_000
    finally:
        spark.conf.set(key, before)
