"""The chunked window operators give what a plain window gives, hot keys or not."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runwarden.operators.ordering import CHUNK, Ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(300):
        # Key "a" holds a third of all rows; one key is null.
        key = rng.choice(["a", "a", "b", "c", None, "d"])
        value = rng.choice([None, rng.randrange(50)])
        data.append((key, rng.randrange(40), i, value))
    return spark.createDataFrame(data, "k string, t int, id int, v int")


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select("id", *columns).collect())


def check(rows):
    plain = Window.partitionBy("k").orderBy("t", "id")
    upto = plain.rowsBetween(Window.unboundedPreceding, 0)
    before = plain.rowsBetween(Window.unboundedPreceding, -1)
    want = (
        rows.withColumn("next", F.lead("v").over(plain))
        .withColumn("last", F.last("v", True).over(upto))
        .withColumn("prev", F.last("v", True).over(before))
        .withColumn("total", F.sum(F.coalesce("v", F.lit(0))).over(upto))
        .withColumn("no", F.row_number().over(plain))
        .withColumn("top", F.max("v").over(upto))
        .withColumn("all", F.sum("v").over(Window.partitionBy("k")))
    )
    line = Ordered(rows, ["k"], ["t", "id"])
    line = line.lead("v", "next").last("v", "last").last("v", "prev", include_current=False)
    line = line.running_sum({"total": F.coalesce("v", F.lit(0))}).number("no")
    line = line.running_max("v", "top").total("all", F.col("v"))
    names = ["next", "last", "prev", "total", "no", "top", "all"]
    assert collected(line.rows, *names) == collected(want, *names)


def test_whole_keys(rows):
    check(rows)


def test_keys_in_many_chunks(rows, hot):
    check(rows)


def test_a_key_is_cut_into_small_chunks(rows, hot):
    chunked = Ordered(rows, ["k"], ["t", "id"]).df
    largest = chunked.groupBy("k", CHUNK).count().agg(F.max("count")).first()[0]
    assert largest < rows.where("k = 'a'").count() / 4


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp", "string", "decimal(20,3)"])
def test_chunks_ascend_with_every_kind_of_order(spark, hot, kind):
    """Negative and tiny numbers, NaN and nulls included."""
    numbers = [None, *range(-40, 40)] + ([float("nan"), 1e-9, -1e-9, 1e300] if kind == "double" else [])
    frame = spark.createDataFrame([(float(n) if n is not None else None, i) for i, n in enumerate(numbers)], "t double, id int")
    cast = F.timestamp_seconds("t") if kind == "timestamp" else F.col("t").cast(kind)
    frame = frame.withColumn("t", cast)
    got = Ordered(frame, [], ["t", "id"]).number("no").rows
    want = frame.withColumn("no", F.row_number().over(Window.partitionBy().orderBy("t", "id")))
    assert collected(got, "no") == collected(want, "no")


def test_the_plan_does_not_depend_on_the_size(rows):
    """No job runs before the result is asked for, and the rows are shuffled once by key and chunk."""
    tracker = rows.sparkSession.sparkContext.statusTracker()
    before = tracker.getJobIdsForGroup(None)
    Ordered(rows, ["k"], ["t", "id"]).lead("v", "next").number("no")
    assert sorted(tracker.getJobIdsForGroup(None)) == sorted(before)


def test_one_global_line(rows, hot):
    total = Ordered(rows, [], ["t", "id"]).running_sum({"s": F.lit(1)}).rows
    assert sorted(r.s for r in total.collect()) == list(range(1, rows.count() + 1))


def test_running_sum_is_null_until_the_first_value(spark, hot):
    rows = [("a", i, None if i < 12 else i) for i in range(40)]
    frame = spark.createDataFrame(rows, "k string, t int, v int")
    got = Ordered(frame, ["k"], ["t"]).running_sum({"s": F.col("v")}).rows.orderBy("t").collect()
    assert [r.s for r in got] == [None] * 12 + [sum(range(12, i + 1)) for i in range(12, 40)]
