"""Exact percentiles without a buffer of values per key.

Equal values are counted before they move.  The counts are range partitioned on (keys,
value) and written, totals of each part are carried to the parts after it, and the value
whose running count covers a wanted rank is picked.  So a key that holds all rows is
spread over all tasks, and no task keeps more than one row in memory.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runwarden.session import materialize

PART = "_part"


def value_counts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n) in range partitions of ``_part``, written so that every reader sees the same parts."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(*[F.col(c) for c in (*keys, value)])
    return materialize(ranged.withColumn(PART, F.spark_partition_id()))


def running_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``upto``, the rows of the key up to and including the value, and ``total``."""
    keys = list(keys)
    parts = counts.groupBy(*keys, PART).agg(F.sum("n").alias("_n"))
    # A key has a row here for each part it reaches into; parts are as many as partitions.
    order = Window.partitionBy(*keys).orderBy(PART)
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carry = parts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(PART).alias("_k_part"),
        F.coalesce(before, F.lit(0)).alias("_before"), total.alias("total"),
    )
    on = F.col(PART) == F.col("_k_part")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    inside = Window.partitionBy(PART, *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = counts.withColumn("_upto", F.sum("n").over(inside)).join(carry, on)
    return joined.withColumn("upto", F.col("_upto") + F.col("_before")).drop(
        "_upto", "_before", "_k_part", PART, *[f"_k_{k}" for k in keys]
    )


def _at_rank(rank: Column, value: str) -> Column:
    """Value of the row whose running count covers a rank, counted from 1."""
    here = (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)
    return F.max(F.when(here, F.col(value)))


def nearest_rank(q: float, value: str) -> Column:
    """Aggregate over :func:`running_counts`: smallest value with at least a share ``q`` of the rows up to it."""
    # A decimal share, so that 0.07 of 100 rows are seven.
    rank = F.ceil(F.col("total") * F.lit(Decimal(str(q)))).cast("bigint")
    return _at_rank(F.greatest(rank, F.lit(1)), value)


def median(value: str) -> Column:
    """Aggregate over :func:`running_counts`: mean of the two middle values."""
    low, high = F.ceil(F.col("total") / 2), F.floor(F.col("total") / 2) + 1
    return (_at_rank(low, value) + _at_rank(high, value)) / 2


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, float]) -> DataFrame:
    """(keys, one column per rank, ``samples``): nearest-rank percentiles of the non-null values of each key.

    A null key is a key; keys without a value have no row.
    """
    running = running_counts(value_counts(rows.select(*keys, value), keys, value), keys, value)
    found = [nearest_rank(q, value).alias(name) for name, q in ranks.items()]
    return running.groupBy(*keys).agg(*found, F.max("total").alias("samples"))
