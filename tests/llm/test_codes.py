"""Vector codes, token ids and periodic runs against plain Python and the library."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runwarden.llm.command_runs import command_runs
from runwarden.llm.command_tokens import LastTokens, TrieWalk, decode_command_lines, encode_command_lines
from runwarden.llm.profile_codes import compress_profiles, nearest_entries, profile_vectors
from runwarden.plans.views import Tables

SMALL = "/root/testdata/sf0.001"
COMMANDS = "event_id bigint, command_line string, ids string, n_words string, words array<string>"
random.seed(11)


@pytest.fixture(scope="module")
def tokenizer_file():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


# --- periodic runs ----------------------------------------------------------------------------------


def runs_of(words):
    """All runs by definition: every period, every maximal stretch, the smallest period of a stretch."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((low, high - low, q) for (low, high), q in found.items())


def expected_runs(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = runs_of(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return len(words), runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def run_texts():
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "é é é é é é é é é", "x\x0by x\x0cy x\ry x y"]
    for _ in range(150):
        letters, text = "abc"[: random.randint(1, 3)], []
        for _ in range(random.randint(1, 5)):
            root = [random.choice(letters) for _ in range(random.randint(1, 23))]
            text += (root * random.randint(1, 8))[: random.randint(1, 150)]
        out.append(random.choice((" ", "  ", "\n")).join(text))
    out += [" ".join((["a"] * k + ["b"]) * 5) for k in range(1, 20)]
    out += [" ".join(["loop"] * 3000), " ".join(f"w{i % 701}" for i in range(3000)), " ".join(str(i) for i in range(5000))]
    return out


def test_runs_equal_brute_force(spark):
    texts = run_texts()
    rows = [(i if i % 7 else None, t, "x", "y", ["z"]) for i, t in enumerate(texts)] * 2
    found = command_runs(spark.createDataFrame(rows, COMMANDS).repartition(3))
    assert found.columns == ["event_id", "n_words", "n_runs", "runs", "strongest", "collapsed"]
    got = sorted(map(repr, ((r.event_id, r.n_words, r.n_runs, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in found.collect())))
    want = []
    for event_id, text, *_ in rows:
        n, runs, best, collapsed = expected_runs(text)
        want.append(repr((event_id, n, len(runs), runs, best, collapsed)))
    assert got == sorted(want)


def test_runs_of_an_empty_table(spark):
    assert command_runs(spark.createDataFrame([], COMMANDS)).count() == 0


def test_a_very_long_line(spark):
    text = "start " + "ab cd " * 400_000 + "end"
    row = command_runs(spark.createDataFrame([(1, text, "", "", [])], COMMANDS)).collect()[0]
    assert [tuple(r) for r in row.runs] == [(1, 800_000, 2)] and row.collapsed == "start ab cd end"


@pytest.mark.skipif(not __import__("os").path.isdir(SMALL), reason="test tables are not here")
def test_runs_of_executions(spark):
    """Command lines of the engine's own executions; one with a retry loop is planted."""
    execs = Tables(spark, SMALL).execs.select("event_id", "command_line", "process_name")
    loop = execs.limit(1).withColumns({"event_id": F.lit("loop"), "command_line": F.lit("/bin/sh -c curl x curl x curl x curl x")})
    found = {r.event_id: r for r in command_runs(execs.unionByName(loop)).collect()}
    assert len(found) == execs.count() + 1
    assert tuple(found["loop"].strongest) == (2, 8, 2) and found["loop"].collapsed == "/bin/sh -c curl x"
    assert all(found[r.event_id].n_runs == len(runs_of(r.command_line.split())) for r in execs.collect())


# --- token ids --------------------------------------------------------------------------------------


def token_texts():
    out = [None, "", " ", "Hello, wörld's 12 THINGS!", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> c", "<|endoftext", "日本語 テキスト",
           "é é ﬁ İ ß", "\u0000\u0001  x y", "👍🏽👍🏽 ok", "aaaaaaaaaaaaaaaaaaaaaaaa", "=" * 500, "x" * 20_000]
    pieces = ["the", "in", "ing", "an", "er", "re", "on", "st", "'s", "'ll", "é", "日", "—", "1", "99", ".", "..", "___", "A", "Z", " ", "\n"]
    out += ["".join(random.choices(pieces, k=random.randint(1, 60))) for _ in range(400)]
    return out


def test_token_ids_equal_the_library(spark, tokenizer_file):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(tokenizer_file), token_texts()
    rows = [(i if i % 9 else None, t, "x", "y", ["z"]) for i, t in enumerate(texts)] * 2
    encoded = encode_command_lines(spark.createDataFrame(rows, COMMANDS).repartition(3), tokenizer_file)
    assert encoded.columns == ["event_id", "n_tokens", "ids"]
    decoded = decode_command_lines(encoded, tokenizer_file)
    got = sorted(map(repr, ((r.event_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.command_line) for r in decoded.collect())))
    want = []
    for event_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append(repr((event_id, len(ids), ids, library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_every_token_as_a_word(tokenizer_file):
    """Words made of vocabulary pieces, where the borders of tokens are most often wrong."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file)
    plain = [t.removesuffix("</w>") for t in list(library.get_vocab())[::7]]
    plain = [t for t in plain if t.isascii() and t.isalpha()]
    words = sorted({w.lower() for w in plain} | {(a + b).lower() for a, b in zip(plain, reversed(plain))})
    walk = TrieWalk(LastTokens(tokenizer_file))
    got = [list(walk.ids(w.encode())) for w in words]
    assert got == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_decoding_defined_cases(spark, tokenizer_file):
    rows = [(1, None, "keep"), (2, b"", "keep"), (3, np.array([320, 2**31], "<u4").tobytes(), "keep")]
    frame = spark.createDataFrame([(a, bytearray(b) if b is not None else None, c) for a, b, c in rows], "event_id int, ids binary, command_line string")
    got = {r.event_id: r.command_line for r in decode_command_lines(frame, tokenizer_file).collect()}
    assert got == {1: None, 2: "", 3: "a</w>"}


def test_encoding_an_empty_table(spark, tokenizer_file):
    assert encode_command_lines(spark.createDataFrame([], COMMANDS), tokenizer_file).count() == 0


# --- vector codes -----------------------------------------------------------------------------------


def plain_codes(rows):
    """The contract word by word, in Python integers; rows of one length of vector."""
    kept = [(i, g, [math.floor(4096 * x) for x in v]) for i, g, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[2]))
    width = len(kept[0][2]) // 8
    cut = [[v[p * width : (p + 1) * width] for p in range(8)] for _, _, v in kept]
    books = [[list(parts[p]) for parts in cut[:16]] for p in range(8)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            held = {}
            for parts in cut:
                held.setdefault(near(parts[p], books[p])[1], []).append(parts[p])
            for k, some in held.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some)]
    found = [[near(parts[p], books[p]) for p in range(8)] for parts in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, g, _), e in zip(kept, errors):
        totals[g] = totals.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((i, g, "".join(f"{k:02x}" for _, k in f), e, totals[g], digest)) for (i, g, _), f, e in zip(kept, found, errors))


PROFILES = "profile_id bigint, image_digest string, vector array<double>, code string, error string, position int"


def coded(frame):
    return sorted(repr(tuple(r)) for r in compress_profiles(frame).collect())


def test_codes_equal_the_contract(spark):
    rng = np.random.default_rng(4)
    rows = [(i, random.choice(["a", "b", None]), np.round(rng.standard_normal(24), 3).tolist()) for i in range(300)]
    rows += [(i, "hot", rows[3][2]) for i in range(300, 500)]  # copies
    rows += [(i, "tie", [float(i % 2)] * 24) for i in range(500, 520)]
    rows += [(600, "a", None), (601, "a", [None] + [0.0] * 23), (602, "a", [float("nan")] * 24), (603, "b", [float("-inf")] * 24)]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PROFILES).repartition(3)
    assert coded(frame) == plain_codes(rows)


def test_codes_of_few_empty_and_odd_vectors(spark):
    frame = spark.createDataFrame([(1, "a", [0.5] * 8, "", "", 0), (2, None, [0.25] * 8, "", "", 0), (2, None, [0.25] * 8, "", "", 0)], PROFILES)
    assert coded(frame) == plain_codes([(1, "a", [0.5] * 8), (2, None, [0.25] * 8), (2, None, [0.25] * 8)])
    odd = spark.createDataFrame(
        [(1, "a", [], "", "", 0), (2, "a", [1.0, 2.0, 3.0], "", "", 0), (3, "a", [1e300] * 3, "", "", 0), (None, "a", [1.0], "", "", 0)], PROFILES
    )
    got = {r.profile_id: r for r in compress_profiles(odd).collect()}
    assert (got[1].code, got[1].error) == ("00" * 8, 0) and (got[None].code, got[None].error) == (None, None)
    assert got[2].error == got[3].error == 0 and got[2].code != got[3].code
    assert compress_profiles(spark.createDataFrame([], PROFILES)).count() == 0


def test_walk_over_a_deep_trie_equals_all_distances():
    rng = np.random.default_rng(9)
    parts = np.unique(rng.integers(-3, 4, (60_000, 8)), axis=0)
    parts = np.concatenate([np.array(list(itertools.product([-9], *[range(4)] * 7))), parts])
    entries = np.concatenate([rng.integers(-3, 4, (15, 8)), [[0] * 8], [[0] * 8]])
    near, distance = nearest_entries(parts, entries)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (near == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


@pytest.mark.skipif(not __import__("os").path.isdir(SMALL), reason="test tables are not here")
def test_codes_of_behaviour_profiles(spark):
    """Vectors of the engine's own token counts per image and window."""
    execs = Tables(spark, SMALL).execs
    counts = execs.groupBy("image_digest", F.expr("us div 86400000000").alias("window"), F.lit("process").alias("family"), F.col("process_name").alias("token")).agg(F.count("*").alias("n"))
    vectors = profile_vectors(counts, 32)
    rows = vectors.collect()
    assert all(len(r.vector) == 32 and sum(map(abs, r.vector)) <= 1 + 1e-9 for r in rows)
    got = compress_profiles(vectors)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_codes([(r.profile_id, r.image_digest, r.vector) for r in rows])
