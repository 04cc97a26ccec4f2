import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runwarden.operators import profile, quantiles, score
from runwarden.plans.behaviour import Behaviour, Interval

START = datetime(2026, 7, 21, 10, 0)
EXEC = (
    "event_id string, occurred_at timestamp, container_id string, process_name string, executable string, "
    "parent_name string, parent_executable string, user_uid bigint, image_digest string"
)
LIFE = (
    "event_id string, occurred_at timestamp, container_id string, event_type string, action string, "
    "image_digest string"
)


def execs(spark, rows):
    data = [
        (i, START + timedelta(seconds=s), c, n, e, None, p, u, "img") for i, s, c, n, e, p, u in rows
    ]
    return spark.createDataFrame(data, EXEC)


TRAINING = [
    ("p1", 5, "c1", "python", "/usr/bin/python", "/bin/sh", 1000),
    ("p2", 20, "c1", "gunicorn", "/usr/bin/gunicorn", "/usr/bin/python", 1000),
    ("p3", 70, "c2", "python", "/usr/bin/python", "/bin/sh", 1000),
    ("p4", 95, "c2", "sh", "/bin/sh", "/usr/bin/python", 0),
]


@pytest.fixture(scope="module")
def training(spark):
    life = [("r1", START + timedelta(seconds=1), "c1", "container", "start", "img"),
            ("r2", START + timedelta(seconds=61), "c2", "container", "start", "img")]
    at = int(START.timestamp() * 1e6)
    at = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    interval = Interval(at, at + 180_000_000, at + 240_000_000, 60_000_000)
    return Behaviour(execs(spark, TRAINING), spark.createDataFrame(life, LIFE), interval)


def test_numeric_summary(training):
    rows = {r.feature: r for r in training.numeric_summary.collect()}
    rate = rows["process_events_per_minute"]
    assert rate.mean == pytest.approx(4 / 3) and rate.median == 2 and rate.p95 == 2
    assert rate.stddev == pytest.approx(0.942809041582)
    assert rows["root_process_ratio"].max == 0.5 and rows["shell_process_ratio"].max == 0.5


def test_distribution_and_bigrams(training):
    shares = {(r.family, r.token): r.p for r in profile.distribution(training.baseline, ["image_digest"]).collect()}
    assert shares["executable", "/usr/bin/python"] == 0.5
    assert shares["executable", "/bin/sh"] == 0.25
    bigrams = {t: p for (f, t), p in shares.items() if f == "process_sequence_bigram"}
    assert bigrams == {"/usr/bin/python -> /usr/bin/gunicorn": 0.5, "/usr/bin/python -> /bin/sh": 0.5}
    for family in {f for f, _ in shares}:
        assert sum(p for (f, _), p in shares.items() if f == family) == pytest.approx(1)


def test_bigrams_do_not_depend_on_input_order_or_skew(spark, hot, monkeypatch):
    rows = [(f"e{i:03}", i % 50, "c1" if i % 3 else "c2", f"n{i % 4}", f"/b/{i % 4}", None, 1) for i in range(90)]
    forward = profile.sequence_bigrams(execs(spark, rows), ["image_digest"]).collect()
    backward = profile.sequence_bigrams(execs(spark, rows[::-1]), ["image_digest"]).collect()
    monkeypatch.undo()  # whole keys
    plain = profile.sequence_bigrams(execs(spark, rows), ["image_digest"]).collect()
    assert sorted(forward) == sorted(backward) == sorted(plain)


def tokens(spark, counts, window=None):
    rows = [("d", "f", t, n) for t, n in counts.items()]
    df = spark.createDataFrame(rows, "image_digest string, family string, token string, n bigint")
    return df if window is None else df.withColumn("w", F.lit(window).cast("bigint"))


def distance(spark, base, seen):
    rows = score.compare_tokens(tokens(spark, base), tokens(spark, seen, 0)).collect()
    return rows[0] if rows else None


def test_distance_edges(spark):
    assert distance(spark, {"a": 1}, {"b": 1}).js_distance == 1.0
    assert distance(spark, {"a": 1, "b": 1}, {"a": 1}).js_distance == pytest.approx(0.557923, abs=1e-6)
    assert distance(spark, {"a": 1, "b": 1}, {"a": 1}).hellinger == pytest.approx(0.541196, abs=1e-6)
    assert distance(spark, {"a": 3, "b": 5}, {"a": 6, "b": 10}).js_distance == 0
    assert distance(spark, {}, {"a": 1}).js_distance == 1
    assert distance(spark, {"a": 1}, {}) is None
    assert distance(spark, {"known": 1}, {"new": 3, "known": 1}).novelty == 0.75


counts = st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 20), min_size=1)


@settings(max_examples=6, deadline=None)
@given(counts, counts)
def test_distance_against_the_formula(spark, base, seen):
    got, back = distance(spark, base, seen), distance(spark, seen, base)
    p = {t: n / sum(base.values()) for t, n in base.items()}
    q = {t: n / sum(seen.values()) for t, n in seen.items()}
    total = 0.0
    for t in set(p) | set(q):
        a, b = p.get(t, 0), q.get(t, 0)
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) / 2 for x in (a, b) if x)
    assert got.js_distance == pytest.approx(math.sqrt(max(0, min(1, total))), abs=1e-7)
    assert got.js_distance == pytest.approx(back.js_distance, abs=1e-9)
    assert 0 <= got.js_distance <= 1 and 0 <= got.hellinger <= 1


def test_numeric_deviation(spark):
    names = ["process_events_per_minute", "runtime_events_per_minute", "distinct_processes_per_window",
             "root_process_ratio", "shell_process_ratio"]
    seen = spark.createDataFrame([("d", 0, 6.0, 0.0, 0.0, 0.0, 0.0), ("d", 1, 9.0, 0.0, 0.0, 0.0, 0.0)], ["image_digest", "w", *names])
    base = spark.createDataFrame([("d", names[0], 3.0, 4.0, 0.8)], "image_digest string, feature string, median double, p95 double, stddev double")
    got = {r.w: r.deviation for r in score.numeric_deviation(seen, base).collect()}
    assert got == {0: 0.25, 1: 1.0}


def test_empty_window_is_insufficient(spark, training):
    rows = training.scores().collect()
    assert [(r.w, r.status, r.total_score) for r in rows] == [(0, "insufficient_data", None)]


def test_event_set_hash_of_a_set_above_a_batch(spark):
    names = [f"process:{i}" for i in range(120_000)]
    rows = [("d", n) for n in names] + [("e", "process:1")]
    ids = spark.createDataFrame(rows, "image_digest string, id string")
    rows = {r.image_digest: r for r in profile.event_set_hash(ids, ["image_digest"]).collect()}
    assert rows["d"].event_set_sha256 == merkle(names)
    assert rows["e"].event_set_sha256 == merkle(["process:1"])
    again = profile.event_set_fingerprint(ids.orderBy(F.desc("id")), ["image_digest"]).collect()
    assert {r.image_digest: r.event_set_fingerprint for r in again}["d"] == rows["d"].event_set_fingerprint


def merkle(names):
    buckets = {}
    for name in sorted(names):
        buckets.setdefault(hashlib.sha256(name.encode()).hexdigest()[:2], []).append(name)
    lines = [f"{b}:{hashlib.sha256(chr(10).join(some).encode()).hexdigest()}" for b, some in sorted(buckets.items())]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_one_set_is_hashed_by_many_tasks(spark):
    """A key with all rows: its buckets meet several tasks."""
    ids = spark.range(20_000).select(F.lit("d").alias("image_digest"), F.concat(F.lit("process:"), "id").alias("id"))
    spread = ids.repartition(8, "image_digest", F.substring(F.sha2("id", 256), 1, profile.BUCKET_DIGITS))
    assert spread.select(F.spark_partition_id()).distinct().count() == 8
    row = profile.event_set_hash(ids, ["image_digest"]).first()
    assert row.event_set_sha256 == merkle([f"process:{i}" for i in range(20_000)]) and row.event_count == 20_000


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_quantiles_of_a_hot_key(spark, parts):
    """One key holds nearly all rows; nulls, ties and a null key are there as well."""
    rng = random.Random(4)
    rows = [("hot", float(rng.randrange(300))) for _ in range(5000)] + [("cold", 1.0), (None, 2.0), (None, 4.0), ("hot", None), ("none", None)]
    frame = spark.createDataFrame(rows, "key string, value double").repartition(parts)
    running = quantiles.running_counts(quantiles.value_counts(frame, ["key"], "value"), ["key"], "value")
    plan = running._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan
    found = running.groupBy("key").agg(quantiles.median("value").alias("median"), quantiles.nearest_rank(0.07, "value").alias("p7"))
    got = {r.key: (r.median, r.p7) for r in found.collect()}
    hot = sorted(v for k, v in rows if k == "hot" and v is not None)
    assert got == {"hot": ((hot[2499] + hot[2500]) / 2, hot[349]), "cold": (1.0, 1.0), None: (3.0, 2.0)}
    got = {r.key: tuple(r)[1:] for r in quantiles.exact_quantiles(frame, ["key"], "value", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got["hot"] == (hot[2499], hot[4949], 5000) and got[None] == (2.0, 4.0, 2)
