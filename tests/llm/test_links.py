"""Joins and searches against brute force: near commands, near profiles, leaks."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from runwarden.llm.near_commands import near_duplicate_commands
from runwarden.llm import near_profiles as near_profiles_module
from runwarden.llm.near_profiles import near_profiles
from runwarden.llm.trial_leaks import WINDOW, leaked_trials, masks_of

random.seed(5)
VOCABULARY = [f"w{i}" for i in range(4000)]
COMMANDS = "event_id bigint, command_line string, n int, component string"


def words(n):
    return random.choices(VOCABULARY, k=n)


def smallest_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def texts():
    out, line = [], words(12)
    hub, chain = words(150), words(120)
    for _ in range(60):  # near copies of a hub, not all near each other
        copy = list(hub)
        for _ in range(random.randint(0, 4)):
            copy[random.randrange(len(copy))] = random.choice(VOCABULARY)
        out.append(" ".join(copy))
    for _ in range(30):  # a chain: each differs a little from the one before
        chain = [*chain[5:], *words(5)]
        out.append(" ".join(chain))
    out += [" ".join(line + words(random.choice((3, 40, 90))) + line) for _ in range(60)]
    out += [" ".join(words(30)).upper()] * 3 + ["a b", "A  b", "a b c", "", None, " \n\t", "é" * 5000]
    random.shuffle(out)
    return list(enumerate(out))


def test_near_commands_equal_brute_force(spark, texts):
    rows = [(i, t, 7, "x") for i, t in texts] + [(0, texts[0][1], 7, "y"), (None, "a b", 7, "z")]
    got = near_duplicate_commands(spark.createDataFrame(rows, COMMANDS), ordered_shingles=64).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t) for i, t in texts}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = smallest_reachable(sets, links)
    for r in got:
        if r.event_id is None:
            assert r.component_id is None and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.event_id]), want[r.event_id])


def test_near_commands_cut_short_meet_members_of_other_leaders(spark):
    # z is x cut short and x is h cut short: both lie within their leaders.  h ends with a passage of many texts.
    rng = random.Random(3)
    pick = lambda n: rng.choices(VOCABULARY, k=n)
    footer, body = pick(21), pick(91)
    nested = [body[:74], body, body + footer]
    rows = [(i, " ".join(t), 0, "") for i, t in enumerate([*nested, *([*pick(300), *footer] for _ in range(6))])]
    got = {r.event_id: r for r in near_duplicate_commands(spark.createDataFrame(rows, COMMANDS)).collect()}
    assert [got[i].n_shingles for i in range(3)] == [70, 87, 108]
    assert [got[i].component_id for i in range(9)] == [0, 0, 0, 3, 4, 5, 6, 7, 8]


def test_near_commands_of_nothing(spark):
    assert near_duplicate_commands(spark.createDataFrame([], COMMANDS)).count() == 0
    blank = near_duplicate_commands(spark.createDataFrame([(1, None, 1, ""), (2, "", 1, "")], COMMANDS)).collect()
    assert {(r.event_id, r.n_shingles, r.component_id) for r in blank} == {(1, 0, 1), (2, 0, 2)}


def test_near_profiles_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(24)
    rows = [(i, i % 2, (centre + 0.08 * rng.standard_normal(24)).tolist(), "x") for i in range(80)]
    rows += [(100 + i, 0, (centre + 0.3 * rng.standard_normal(24)).tolist(), "x") for i in range(40)]
    rows += [(200 + i, 1, rng.standard_normal(24).tolist(), "x") for i in range(80)]
    rows += [(300 + i, 0, rows[0][2], "x") for i in range(5)] + [(310, 0, [2 * v for v in rows[0][2]], "x")]
    bad = [(400, 0, None, "x"), (401, 0, [0.0] * 24, "x"), (402, None, rows[0][2], "x"), (403, 0, [None] * 24, "x")]
    bad += [(404, 0, [float("nan")] * 24, "x"), (405, 0, [], "x"), (None, 1, [1.0, 2.0], "x")]
    frame = spark.createDataFrame(rows + bad, "profile_id bigint, image_digest int, vector array<double>, n_links string")
    got = {r.profile_id: r for r in near_profiles(frame).collect()}
    assert len(got) == len(rows) + len(bad)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v, _ in rows}
    image = {i: d for i, d, _, _ in rows}
    links = [(a, b) for a in unit for b in unit if a < b and image[a] == image[b] and unit[a] @ unit[b] >= 0.93]
    want = smallest_reachable(unit, links)
    found = sum(got[i].n_links for i in unit)
    assert 2 * len(links) * 0.9 <= found <= 2 * len(links)
    degree = {i: sum(i in p for p in links) for i in unit}
    assert all(got[i].n_links <= degree[i] for i in unit)
    assert sum(got[i].component_id == want[i] for i in unit) >= 0.95 * len(unit)
    for i, *_ in bad:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept == (i is not None)


@pytest.mark.parametrize("block", [7, 1024])
def test_near_profiles_find_every_link(spark, monkeypatch, block):
    # Links that no list of neighbours leads to: few among many vectors, and one vector near very many.
    monkeypatch.setattr("runwarden.llm.near_profiles.BLOCK", block)
    if block == 7:  # few nodes are audited, no recall is enough: the exact completion
        monkeypatch.setattr("runwarden.llm.near_profiles.AUDIT_NODES", 50)
        monkeypatch.setattr("runwarden.llm.near_profiles.AUDIT_RECALL", 1.01)
    rng = np.random.default_rng(4)
    vectors = [*rng.standard_normal((400, 16)), *(rng.standard_normal(16) + 0.33 * rng.standard_normal((150, 16)))]
    vectors += [v + 0.3 * rng.standard_normal(16) for v in vectors[:12]]
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "profile_id bigint, image_digest int, vector array<double>")
    got = {r.profile_id: r for r in near_profiles(frame).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(len(unit))[:, None] % 2 == np.arange(len(unit)) % 2)
    np.fill_diagonal(near, False)
    want = smallest_reachable(range(len(unit)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    assert near.sum() > 500
    assert [(got[i].n_links, got[i].component_id) for i in want] == [(near[i].sum(), want[i]) for i in want]


def test_recall_of_the_descent_and_its_audit(spark):
    """The neighbour graph alone, without what the audit adds, and what the audit makes of a poor one."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16))
    vectors = [centres[i % 40] + 0.25 * rng.standard_normal(16) for i in range(800)]
    rows = [(i, i % 2, i, 0.0, v.tolist()) for i, v in enumerate(vectors)]
    nodes = spark.createDataFrame(rows, "node bigint, part bigint, vector_key bigint, radius double, vector array<double>")
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(800)[:, None] % 2 == np.arange(800) % 2)
    true = {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    angle = float(np.arccos(0.93))
    pairs = near_profiles_module._descend(nodes, 800, angle)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert len(true) > 1000 and found <= true and len(found) >= 0.95 * len(true)
    extra, low = near_profiles_module._audit(nodes, 800, pairs.where("a % 4 > 1"), angle)
    assert sorted(low) == [0, 1] and {(r.a, r.b) for r in extra.collect()} == true


def test_near_profiles_of_nothing(spark):
    assert near_profiles(spark.createDataFrame([], "profile_id bigint, image_digest int, vector array<float>")).count() == 0


def test_leaks_tolerate_changed_tokens(spark):
    trials = {i: words(random.choice((6, 9, 20, 45))) for i in range(30)}
    rows, want = [], {}
    for i in range(200):
        body = words(200)
        if i % 4 == 0:
            trial = i // 4 % 30
            passage = list(trials[trial])
            if i % 8 == 0 and len(passage) >= 20:
                for at in random.sample(range(len(passage)), len(passage) // 10):
                    passage[at] = "changed"
            body[50:50] = [p.upper() + "," for p in passage]
            want[i] = trial
        rows.append((i, " ".join(body), trial if i % 4 == 0 else -1))
    rows += [(900, None, 0), (901, "", 0), (None, " ".join(trials[5]), 0)]
    left = spark.createDataFrame(rows, "event_id bigint, command_line string, start int")
    right = spark.createDataFrame(
        [*((i, " ".join(t)) for i, t in trials.items()), (99, None), (98, "w1 w2"), (97, "")], "trial_id bigint, command_line string"
    )
    one = {(r.event_id, r.trial_id) for r in leaked_trials(left, right).collect()}
    assert one == {*want.items(), (None, 5)}
    assert {(r.event_id, r.trial_id) for r in leaked_trials(left, right, pass_bytes=800).collect()} == one
    assert leaked_trials(left, right.limit(0)).count() == 0 and leaked_trials(left.limit(0), right).count() == 0


def test_leak_masks_cover_every_allowed_change():
    for size in range(1, 30):
        span, masks = masks_of(size)
        width = min(size, WINDOW)
        changed = width - -(-80 * width // 100)
        for places in combinations(range(width), changed):
            kept = [{start + p for p in mask} for start in range(width - span + 1) for mask in masks]
            assert any(not k & set(places) for k in kept), (size, places)


def test_short_trials_with_changed_ends_leak(spark):
    rows, trials, want = [], [], set()
    for size in range(1, 14):
        trial = [f"trial{size}x{i}" for i in range(size)]
        trials.append((size, " ".join(trial)))
        changed = size // 5
        for number, places in enumerate(combinations(range(size), changed)):
            passage = [w if i not in places else "changed" for i, w in enumerate(trial)]
            rows.append((size * 1000 + number, " ".join([*words(20), *passage, *words(20)])))
            want.add((size * 1000 + number, size))
        broken = [w if i > changed else "changed" for i, w in enumerate(trial)]
        rows.append((-size, " ".join([*words(20), *broken, *words(20)])))
    left = spark.createDataFrame(rows, "event_id bigint, command_line string")
    right = spark.createDataFrame(trials, "trial_id bigint, command_line string")
    assert {(r.event_id, r.trial_id) for r in leaked_trials(left, right).collect()} == want


def test_leaks_in_typographic_and_unspaced_text(spark):
    plain = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omicron pi"
    dressed = "Intro… ALPHA beta—gamma “delta” epsilon, zeta‘eta’ theta • iota «kappa» lambda my nu xi omicron pi"
    chinese = "今天的天气非常好我们一起去公园散步然后回家吃饭"
    umlauts = "ÄPFEL Öl Übung straße größe fünf zwölf hören müssen schön grün kühl früh spät"
    events = [(1, dressed), (2, "前言：" + chinese + "。后记"), (3, "äpfel öl übung STRASSE größe fünf zwölf hören müssen schön grün kühl früh spät"), (4, "今天去公园")]
    frame = spark.createDataFrame(events, "event_id bigint, command_line string")
    trials = spark.createDataFrame([("a", plain), ("b", chinese), ("c", umlauts)], "trial_id string, command_line string")
    got = {(r.event_id, r.trial_id): r for r in leaked_trials(frame, trials).collect()}
    assert set(got) == {(1, "a"), (2, "b"), (3, "c")}
    assert got[1, "a"].matched == 16 and got[2, "b"].matched == len(chinese) and got[3, "c"].matched == 13


def test_leaks_equal_all_alignments(spark):
    """Every item at every shift, counted token by token, with few words so that repeats are common."""
    pool = random.Random(12)
    def words_like(n):
        return [pool.choice("abcd") for _ in range(n)] if pool.random() < 0.5 else ([pool.choice("ab") for _ in range(pool.randint(1, 9))] * n)[:n]
    trials = [(i, words_like(pool.choice((4, 9, 13, 20, 30)))) for i in range(25)]
    events = [(i, words_like(pool.randint(0, 60)) + (list(pool.choice(trials)[1]) if pool.random() < 0.6 else []) + words_like(5)) for i in range(60)]
    want = {}
    for e, text in events:
        for t, trial in trials:
            width, found = min(13, len(trial)), None
            for shift in range(-len(trial), len(text) + 1):
                begin, end = max(0, -shift), min(len(trial), len(text) - shift)
                same = [trial[i] == text[i + shift] for i in range(begin, end)]
                top = max((sum(same[i : i + width]) for i in range(len(same) - width + 1)), default=-1)
                if 100 * top >= 80 * width:
                    found = max(found or (-1, 0, 0), (sum(same), -(begin + shift), len(same)))
            if found:
                want[e, t] = found
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in events], "event_id bigint, command_line string")
    got = {(r.event_id, r.trial_id): (r.matched, r.start, r.compared) for r in leaked_trials(
        frame, spark.createDataFrame([(i, " ".join(w)) for i, w in trials], "trial_id bigint, command_line string")).collect()}
    assert set(got) == set(want) and len(want) > 50
    assert all(got[k][0] <= want[k][0] and got[k][0] >= 0.9 * want[k][0] for k in want)


def test_a_repeated_token_in_a_long_text_is_quick():
    import time

    import pyarrow as pa

    from runwarden.llm.trial_leaks import SeedIndex, tokens_of

    index = SeedIndex([1, 2], pa.array(["x " * 300, "x y z " * 100]))
    tokens, first = tokens_of(pa.array(["x " * 20_000, "x y z " * 7_000]))
    list(index.verified(*tokens_of(pa.array(["a b c"]))))
    started = time.perf_counter()
    found = sorted(index.verified(tokens, first))
    assert time.perf_counter() - started < 3
    assert found == [(0, 0, 0, 300, 300), (1, 1, 0, 300, 300)]
