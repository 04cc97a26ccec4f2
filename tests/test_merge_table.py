"""Commits of a merge table: repeated, killed in between, compacted, null keys."""

import os

import pytest
from pyspark.sql import functions as F

from runwarden.sources.merge_table import MergeTable, first_of_key

ROWS = "key string, value bigint"


def table_at(spark, where, fanout=3):
    return MergeTable(spark, str(where), first_of_key(["key"]), fanout)


def contents(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_the_first_row_of_a_key_stays_through_compactions(spark, tmp_path):
    table, want = table_at(spark, tmp_path), {}
    assert table.read() is None
    for batch in range(11):
        rows = [(f"k{(batch * 7 + i) % 20}", batch) for i in range(6)] + [(None, batch)]
        for key, value in rows:
            want.setdefault(key, value)
        assert table.commit(spark.createDataFrame(rows, ROWS), "s", batch)
    assert contents(table) == sorted(want.items(), key=str)
    levels = [run["level"] for run in table.manifest()["runs"]]
    assert max(levels) == 2 and all(levels.count(x) < 3 for x in levels)


def test_a_repeated_batch_is_committed_once(spark, tmp_path):
    table = table_at(spark, tmp_path)
    assert table.commit(spark.createDataFrame([("a", 1)], ROWS), "s", 0)
    assert not table.commit(spark.createDataFrame([("a", 2), ("b", 2)], ROWS), "s", 0)
    assert table.commit(spark.createDataFrame([("a", 3), ("c", 3)], ROWS), "another", 0)
    assert contents(table) == [("a", 1), ("c", 3)]


def test_a_batch_killed_before_its_manifest_leaves_nothing(spark, tmp_path, monkeypatch):
    table = table_at(spark, tmp_path)
    table.commit(spark.createDataFrame([("a", 1)], ROWS), "s", 0)
    batch = spark.createDataFrame([("a", 2), ("b", 2)], ROWS)

    def killed(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(table, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            table.commit(batch, "s", 1)
    assert contents(table) == [("a", 1)] and len(os.listdir(tmp_path / "runs")) == 2
    assert table.commit(batch, "s", 1) and contents(table) == [("a", 1), ("b", 2)]
    assert len(table.vacuum(keep=1)) == 2 and contents(table) == [("a", 1), ("b", 2)]


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    one, other = table_at(spark, tmp_path), table_at(spark, tmp_path)
    stale = other.manifest()
    one.commit(spark.createDataFrame([("a", 1)], ROWS), "s", 0)
    with pytest.raises(RuntimeError):
        other._publish({**stale, "number": stale["number"] + 1})
    assert contents(one) == [("a", 1)]


def test_a_commit_reads_only_the_runs_it_compacts(spark, tmp_path, monkeypatch):
    """What a batch reads does not grow with the table."""
    table, read = table_at(spark, tmp_path, fanout=4), []
    plain = table._rows
    monkeypatch.setattr(table, "_rows", lambda runs, schema: read.append(len(runs)) or plain(runs, schema))
    for batch in range(9):
        table.commit(spark.range(50).select(F.concat(F.lit(f"{batch}-"), "id").alias("key"), F.col("id").alias("value")), "s", batch)
    assert read == [4, 4] and table.read().count() == 450
