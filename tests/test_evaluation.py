import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runwarden.functions.hashing import assign_split
from runwarden.functions.stats import clopper_pearson, mcnemar_p
from runwarden.operators import evaluate, rarity


def test_splits(spark):
    ids = ["run-01", "run-02", "trial-1", "trial-2", "trial-3"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", assign_split(F.col("id")).alias("s"))
    assert [r.s for r in rows.orderBy("id").collect()] == ["calibration", "calibration", "test", "fit", "fit"]


def test_exact_intervals(spark):
    rows = spark.createDataFrame([(5, 20), (0, 10), (10, 10), (50, 100), (0, 0)], "x bigint, n bigint")
    got = rows.select("x", "n", clopper_pearson()("x", "n").alias("i")).select("x", "n", "i.*").collect()
    want = {(5, 20): (0.08657781, 0.49104968), (0, 10): (0, 0.30849711), (10, 10): (0.69150289, 1),
            (50, 100): (0.39832113, 0.60167887), (0, 0): (0, 1)}
    for r in got:
        # The published values hold to four digits; the defining tails hold exactly.
        assert (r.lower, r.upper) == pytest.approx(want[r.x, r.n], abs=1e-4)
        if 0 < r.x < r.n:
            tail = [math.comb(r.n, i) * r.lower**i * (1 - r.lower) ** (r.n - i) for i in range(r.x, r.n + 1)]
            assert sum(tail) == pytest.approx(0.025, abs=1e-9)


def test_tails_need_no_memory_for_a_billion_trials(spark):
    n = 1_000_000_000
    rows = spark.createDataFrame([(n // 2, n // 2), (n // 2 + 100_000, n // 2 - 100_000), (1, n)], "a bigint, b bigint")
    got = rows.select("a", mcnemar_p(F.col("a"), F.col("b")).alias("p"), clopper_pearson()("a", F.lit(n)).alias("i")).collect()
    by = {r.a: r for r in got}
    assert by[n // 2].p == 1 and by[1].p == 0
    # Normal approximation with continuity correction; its own error is below 1e-6 here.
    assert by[n // 2 + 100_000].p == pytest.approx(math.erfc((100_000 - 0.5) / math.sqrt(n / 2)), rel=1e-5)
    assert by[1].i.lower == pytest.approx(-math.log(1 - 0.025) / n, rel=1e-6)
    spread = 1.959963984540054 * math.sqrt(0.25 / n)
    assert by[n // 2].i.upper - 0.5 == pytest.approx(spread, rel=1e-4)


def test_mcnemar(spark):
    rows = spark.createDataFrame([(3, 9), (0, 0), (0, 53), (4, 4)], "a bigint, b bigint")
    got = {(r.a, r.b): r.p for r in rows.withColumn("p", mcnemar_p(F.col("a"), F.col("b"))).collect()}
    assert got[3, 9] == pytest.approx(0.14599609375, rel=1e-12)
    assert got[0, 0] == 1 and got[4, 4] == 1
    assert got[0, 53] == pytest.approx(2.220446049250313e-16, rel=1e-9)


def test_holm(spark):
    rows = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.005)], "family string, contrast string, p_value double")
    got = {r.contrast: r.adjusted_p for r in evaluate.holm(rows).collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02})


@pytest.mark.parametrize(
    "values, x, p", [([0.1, 0.2, 0.2], 0.2, 3 / 4), ([1.0, 2.0, 3.0], 4.0, 1 / 4), (list(map(float, range(10))), 100.0, 1 / 11),
                     (list(map(float, range(10))), 9.0, 2 / 11)],
)
def test_pvalues(spark, hot, values, x, p):
    calibration = spark.createDataFrame([("m", v) for v in values], "m string, value double")
    tests = spark.createDataFrame([("m", 1, x), ("none", 2, x)], "m string, id int, value double")
    got = {r.id: r for r in rarity.empirical_pvalues(calibration, tests, ["m"]).collect()}
    assert got[1].p_value == pytest.approx(p) and got[1].rarity == pytest.approx(1 - p)
    assert got[2].status == "insufficient_data" and got[2].p_value is None


def test_fusion_and_blocks(spark):
    names = ["categorical_shift", "sequence_surprisal", "novelty_mass", "numeric_tail"]
    rows = spark.createDataFrame([(1, n, v) for n, v in zip(names, [0.9, None, 0.3, 0.6])], "k int, component string, rarity double")
    got = rarity.fuse_ranks(rows, ["k"]).first()
    assert got.rarity == pytest.approx(0.6) and got.missing == ["sequence_surprisal"]
    with pytest.raises(ValueError):
        rarity.fuse_ranks(rows, ["k"], ["a", "a"])
    values = spark.createDataFrame([("r", 0.2), ("r", 1.5), ("r", 0.7), ("bad", -1.0)], "run string, value double")
    blocks = {r.run: r for r in rarity.block_statistics(values, ["run"]).collect()}
    assert blocks["r"].block_statistic == 1.5 and blocks["r"].valid and not blocks["bad"].valid


def test_markov(spark):
    types = "k string, source string, target string, n bigint"
    fit = spark.createDataFrame([("k", "sh", "sleep", 3)], types)
    seen = spark.createDataFrame([("k", "sh", "sleep", 1), ("k", "sh", "curl", 1)], types)
    got = rarity.markov_surprisal(fit, seen, ["k"]).first()
    assert got.score == pytest.approx(1.321928, abs=1e-6)
    assert (got.transition_count, got.unseen_count) == (2, 1)


def test_context_delta(spark):
    base = (False, ["a"], True, "bridge", None, 1)
    rows = [(base, base), (base, (False, ["NET_RAW"], *base[2:])), (base, (True, *base[1:])), (base, (True, [], False, "host", 1, None))]
    types = "struct<privileged:boolean,capabilities:array<string>,read_only_rootfs:boolean,network_mode:string,mounts:int,devices:int>"
    df = spark.createDataFrame(rows, f"r {types}, o {types}")
    score, fields = evaluate.context_delta("r", "o")
    got = df.select(score.alias("s"), fields.alias("f")).collect()
    assert [r.s for r in got] == [0, 0.30, 0.35, 1.0]
    assert got[1].f == ["capabilities"]


def test_boundaries_keep_trials_apart(spark):
    made = [(t, s) for t in ("t0", "t1") for s in range(1, 13)]
    seen = [(t, "source", s) for t, s in made if (t, s) not in {("t1", 3), ("t1", 9)}]
    generated = spark.createDataFrame(made, "trial_id string, sequence bigint")
    observed = spark.createDataFrame(seen, "trial_id string, boundary string, sequence bigint")
    boundaries = spark.createDataFrame(
        [(t, b, b == "source") for t in ("t0", "t1") for b in ("source", "api")], "trial_id string, boundary string, measured boolean"
    )
    lost = evaluate.missing_sequences(generated, observed, boundaries).collect()
    assert sorted((r.trial_id, r.sequence) for r in lost) == [("t1", 3), ("t1", 9)]
    got = {(r.trial_id, r.boundary): r for r in evaluate.reconcile_boundaries(generated, observed, boundaries).collect()}
    assert got["t1", "source"].loss_fraction == pytest.approx(2 / 12)
    assert got["t0", "source"].missing == 0
    assert got["t0", "api"].status == "unmeasured" and got["t0", "api"].missing is None


def test_bootstrap(spark):
    strata = spark.createDataFrame([("a", 40, 40), ("b", 20, 10)], "stratum string, runs bigint, detected bigint")
    one = evaluate.bootstrap_recall(strata, 0.9, resamples=2000).first()
    two = evaluate.bootstrap_recall(strata.orderBy(F.desc("stratum")), 0.9, resamples=2000).first()
    assert one == two
    assert one.point_estimate == pytest.approx(50 / 60)
    assert one.lower < 50 / 60 < one.upper and not one.non_inferior
    sure = evaluate.bootstrap_recall(spark.createDataFrame([("a", 96, 96)], strata.schema), 1.0, resamples=500).first()
    assert (sure.lower, sure.upper, sure.non_inferior) == (1.0, 1.0, True)


def test_bootstrap_draws_are_binomial():
    evenly = (np.arange(20_000) + 0.5) / 20_000
    for runs, detected in [(7, 2), (50, 49), (400, 200), (3, 0), (5, 5)]:
        hits = evaluate._binomial_hits(runs, detected, evenly)
        for value in range(runs + 1):
            chance = math.comb(runs, value) * (detected / runs) ** value * (1 - detected / runs) ** (runs - value)
            assert abs((hits == value).mean() - chance) < 2 / 20_000
    # A stratum of any size needs the root of its runs.
    many = evaluate._binomial_hits(10**10, 3 * 10**9, evenly)
    assert abs(many.mean() / 3e9 - 1) < 1e-6 and many.std() == pytest.approx(math.sqrt(10**10 * 0.21), rel=0.01)


def test_bootstrap_of_each_arm(spark):
    rows = [("x", "a", 40, 40), ("x", "b", 20, 10), ("y", "a", 9, 3), (None, "a", 5, 5), ("z", "a", 0, 0)]
    strata = spark.createDataFrame(rows, "scope string, stratum string, runs bigint, detected bigint")
    got = {r.scope: (r.runs, r.lower, r.upper) for r in evaluate.bootstrap_interval(strata, ["scope"], 500).collect()}
    one = evaluate.bootstrap_interval(strata.where("scope = 'x'"), (), 500).first()
    assert set(got) == {"x", "y", None} and got["x"] == (60, one.lower, one.upper) and got[None] == (5, 1.0, 1.0)
    assert evaluate.bootstrap_interval(strata.where("false"), (), 500).count() == 0


def test_recall_gate_uses_the_lower_bound(spark):
    # Fine arm 18 of 20 and coarse arm 18 of 20: equal points, but the bound is further below.
    rows = [(s, f"t{i}", "f", "s", "test", True, True, i < 18) for s in ("fine", "coarse") for i in range(20)]
    schema = "scope string, trial_id string, workload_family string, scenario_id string, split string, attack_like boolean, has_reference boolean, positive boolean"
    scored = spark.createDataFrame(rows, schema)
    arms = spark.createDataFrame([("c", "fine", "coarse"), ("none", "absent", "coarse")], "contrast string, fine string, coarse string")
    got = {r.contrast: r for r in evaluate.recall_not_inferior(scored, arms).collect()}
    assert got["c"].recall_lower < 0.85 and not got["c"].non_inferior
    assert got["none"].recall_lower is None and not got["none"].non_inferior
    assert evaluate.recall_not_inferior(scored, arms, margin=0.5).where("contrast = 'c'").first().non_inferior


def test_holm_in_chunks(spark, hot):
    rng = random.Random(3)
    rows = [("all" if i % 3 else f"f{i % 5}", f"c{i}", round(rng.random() ** 4, 3)) for i in range(400)] + [(None, "n", 0.5)]
    tests = spark.createDataFrame(rows, "family string, contrast string, p_value double")
    want = {}
    for family in {r[0] for r in rows}:
        reached, mine = 0.0, sorted((p, c) for f, c, p in rows if f == family)
        for place, (p, c) in enumerate(mine):
            reached = max(reached, min(1.0, p * (len(mine) - place)))
            want[c] = reached
    assert {r.contrast: r.adjusted_p for r in evaluate.holm(tests).collect()} == pytest.approx(want)


def test_degenerate_contrasts(spark):
    rows = [("const", i, True, i % 2 == 0) for i in range(6)] + [("same", i, i < 3, i < 3) for i in range(6)]
    rows += [("fine", i, i < 3, i % 2 == 0) for i in range(6)]
    pairs = spark.createDataFrame(rows, "contrast string, trial_id int, a boolean, b boolean")
    got = {r.contrast: r.degeneracy for r in evaluate.degeneracy(evaluate.mcnemar(pairs)).collect()}
    assert got == {"const": "arm_a_constant", "same": "no_discordant_pairs", "fine": "informative"}


def test_decisions(spark):
    rows = spark.createDataFrame(
        [("ok", 1.0, 0.0, 0.001, True, True), ("none", 0.0, 0.0, 0.001, True, True), ("p", 1.0, 0.0, 0.2, True, True),
         ("recall", 1.0, 0.0, 0.001, False, True), ("vacuous", 1.0, 0.0, 0.001, True, False)],
        "contrast string, fpr_a double, fpr_b double, adjusted_p double, non_inferior boolean, informative boolean",
    )
    got = {r.contrast: r.reason for r in evaluate.decide_contrasts(rows).collect()}
    assert got == {"ok": "supported", "none": "reduction_too_small", "p": "not_significant",
                   "recall": "recall_inferior", "vacuous": "uninformative"}
