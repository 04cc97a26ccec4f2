"""Held-out accuracy of the learned models, and the pipeline stage by stage."""

import os
import zlib

import pytest

import corpus_pipeline
from runwarden.llm.benign_commands import BUCKETS, fit_benign_model, score_benign
from runwarden.llm.description_language import calibrate_temperature, identify_language
from runwarden.llm.queries_models import op2_language_id, op10_quality_classifier
from runwarden.llm.queries_near import op1_ngram_jaccard_join
from runwarden.llm.queries_texts import op5_decontamination

SMALL = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@needs_tables
def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op2_language_id(spark, SMALL).collect()
    assert len(got) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    rows = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)


@needs_tables
def test_quality_on_held_out_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = [r for r in op10_quality_classifier(spark, SMALL).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_language_edge_cases(spark):
    training = spark.createDataFrame(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("", "fr"), ("x", None)] * 20,
        "description string, language string",
    )
    texts = ["the dog", "le chien", None, "", "12 %%", "the " * 20000]
    findings = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the cat", 1)], "finding_id int, description string, score int")
    got = {r.finding_id: r for r in identify_language(findings, training).collect()}
    assert [got[i].language for i in (0, 1, 2, 3, 4, 5, None)] == ["en", "fr", "und", "und", "und", "en", "en"]
    assert got[2].score == 0 and identify_language(findings.limit(0), training).count() == 0
    assert {r.language for r in identify_language(findings, training.limit(0)).collect()} == {"und"}


def test_temperature_finds_the_scale():
    import numpy as np

    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert abs(calibrate_temperature(5 * logits, labels) - 5) < 0.6


def test_benign_edge_cases(spark):
    training = spark.createDataFrame(
        [("ls -l /tmp", 1), ("NC!! -E!! SH!!", 0), (None, 1), ("", 0), ("x", None), ("y", 5)] * 30, "command_line string, benign int"
    )
    rows = spark.createDataFrame([(1, "ls -l", 0), (2, "NC!! SH!!", 0), (3, None, 0), (4, "", 0), (None, "ls " * 9000, 0)], "event_id int, command_line string, predicted int")
    got = {r.event_id: r for r in score_benign(rows, training).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].score == got[4].score and len(got) == 5
    assert score_benign(rows.limit(0), training).count() == 0
    assert {r.score for r in score_benign(rows, training.limit(0)).collect()} == {0.5}


def test_benign_fit_brings_one_number_a_bucket(spark):
    training = spark.createDataFrame([("ls -l /tmp", 1), ("nc -e sh", 0)] * 10, "command_line string, benign int")
    margins, bias = fit_benign_model(training)
    assert margins.shape == (2 * BUCKETS,) and margins.any() and isinstance(bias, float)


@needs_tables
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert number == 4 or docs.columns == columns
    everything = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}
    assert kept[0] == {r.doc_id for r in op2_language_id(spark, SMALL).where("lang_pred <> 'und' AND score >= 0.5").collect()} <= everything
    for number in (0, 1, 2):  # the next stages, on what is there
        assert kept[number + 1] <= kept[number]
    os.makedirs(f"{tmp_path}/q")
    os.symlink(f"{tmp_path}/1", f"{tmp_path}/q/documents.parquet")
    os.symlink(f"{SMALL}/benchmark.parquet", f"{tmp_path}/q/benchmark.parquet")
    groups = op1_ngram_jaccard_join(spark, f"{tmp_path}/q").where("doc_id = component_id")
    assert kept[2] == {r.doc_id for r in groups.collect()}
    leaks = {r.doc_id for r in op5_decontamination(spark, f"{tmp_path}/q").collect()}
    assert kept[3] == kept[2] - leaks and kept[4] == kept[3]


CLASHING = "language string, score int, predicted int, finding_id int, event_id int, description string, others int"


def test_stages_bear_nulls_and_empty_tables(spark, tmp_path):
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
    more = ("x", 1, 0, 7, 8, "y", 9)
    rows = [(1, None, None, None, None, *more), (None, "a b", "en", "s", 3, *more), (3, "", "en", "s", 0, *more), (3, "", "en", "s", 0, *more)]
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(spark, docs, str(tmp_path))
            assert found.count() <= len(table) and (number == 4 or found.columns == docs.columns)
            if number < 4:
                assert all(tuple(r)[5:] == more for r in found.collect())


def test_stages_keep_clashing_columns(spark, tmp_path):
    """A leaked text goes with every id, a null one too; what stays keeps all its columns."""
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
    import random

    pool = random.Random(2)
    good = [" ".join(pool.choices(["river", "stone", "bright", "walks", "under", "seven", "paper", "green"], k=40)) for _ in range(60)]
    passage = " ".join(f"benchmark{i}" for i in range(30))
    texts = good + [passage, f"{good[0]} {passage}"]
    rows = [(i, t, "en", "s", len(t), "x", i, 0, 7, 8, "y", 9) for i, t in enumerate(texts)]
    rows += [(None, passage, "en", "s", 1, "x", -1, 0, 7, 8, "y", 9), (None, good[1], "en", "s", 1, "x", -2, 0, 7, 8, "y", 9)]
    spark.createDataFrame([(i, 1, 0) for i in range(62)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    want = {(r[0], r[1], r[6]) for r in rows if passage not in r[1]}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.columns[5:] == ["language", "score", "predicted", "finding_id", "event_id", "description", "others"]
    assert {(r.doc_id, r.text, r.score) for r in docs.collect()} == want


def test_samples_are_bounded_and_never_empty(spark):
    from runwarden.llm.sampling import bounded_sample

    rows = [("x" * 5000, "a")] + [(f"t{i}", "a") for i in range(500)] + [("copy", "b")] * 500 + [("y" * 9000, "c")]
    frame = spark.createDataFrame(rows, "text string, language string").repartition(5)
    got = bounded_sample(frame, "text", 90, most_bytes=8000, by="language").collect()
    count = {k: sum(r.language == k for r in got) for k in "abc"}
    assert count == {"a": 30, "b": 30, "c": 1} and all(len(r.text) < 10 for r in got if r.language == "a")
    assert sorted(got) == sorted(bounded_sample(frame.repartition(3), "text", 90, most_bytes=8000, by="language").collect())
    assert bounded_sample(frame.limit(0), "text", 10).count() == 0 and bounded_sample(frame, "text", 10).count() == 10
