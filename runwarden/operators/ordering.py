"""Ordered operators that stay balanced when one key holds most of the rows.

``Window.partitionBy(key).orderBy(time)`` sorts a whole key in one task.  The functions here
give the same answers, but every key is cut into chunks by fixed steps of its first order
column (a day of a time, 4096 of a count, steps of the logarithm of other numbers).  Windows
run per (key, chunk), and a carry of one row per chunk connects the chunks.  The plan is
the same for every size of input: the rows are shuffled once by (key, chunk), nothing is
measured beforehand, and Spark chooses how the small carry is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of times, in microseconds, of counts, and per doubling of other numbers.
TIME_STEP = 86_400_000_000
COUNT_STEP = 4096
STEPS_PER_DOUBLING = 8
CHUNK, KEY = "_order_chunk", "_order_key"
_LEAST, _MOST = -(2**63), 2**63 - 1


def chunk_of(kind: str, name: str) -> Column:
    """Chunk of an order column; chunks ascend with the values, null is before all of them."""
    value = F.col(name)
    if kind in ("timestamp", "timestamp_ntz"):
        step = F.floor(F.unix_micros(value.cast("timestamp")) / TIME_STEP)
    elif kind == "bigint":
        step = F.floor(value / TIME_STEP)
    elif kind in ("int", "smallint", "tinyint"):
        step = F.floor(value / COUNT_STEP)
    elif kind in ("double", "float") or kind.startswith("decimal"):
        number = value.cast("double")
        size = F.signum(number) * F.log2(1 + F.abs(number) * F.lit(2.0**20)) * STEPS_PER_DOUBLING
        step = F.when(F.isnan(number), F.lit(_MOST)).otherwise(F.floor(F.least(F.greatest(size, F.lit(-1e12)), F.lit(1e12))))
    elif kind == "string":
        step = F.ascii(value)
    else:
        raise ValueError(f"no order in chunks for {name}, a {kind}")
    return F.coalesce(step.cast("bigint"), F.lit(_LEAST).cast("bigint"))


def _carried(rows: DataFrame, aggregates: Sequence[Column], carry: Column) -> DataFrame:
    """(key, chunk, ``_carry``) of keys with several chunks."""
    per_chunk = rows.groupBy(KEY, CHUNK).agg(*aggregates)
    pieces = F.count(F.lit(1)).over(Window.partitionBy(KEY))
    found = per_chunk.withColumns({"_pieces": pieces, "_carry": carry}).where("_pieces > 1")
    return found.select(F.col(KEY).alias("_carry_key"), F.col(CHUNK).alias("_carry_chunk"), "_carry")


def _attach(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """The carry next to its rows, which are shuffled by (key, chunk) already."""
    return rows.join(carry, (F.col(KEY) == F.col("_carry_key")) & (F.col(CHUNK) == F.col("_carry_chunk")), "left").drop(
        "_carry_key", "_carry_chunk"
    )


class Ordered:
    """Rows in order within each key; each method adds a column and returns a new object.

    ``order`` must be unique within a key.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.order = list(order)
        # One struct as key: its fields may be null, the struct never is.
        key = F.struct(*keys) if keys else F.lit(0)
        self.df = df.withColumns({KEY: key, CHUNK: chunk_of(dict(df.dtypes)[order[0]], order[0])})

    def _with(self, df: DataFrame) -> Ordered:
        other = object.__new__(Ordered)
        other.order, other.df = self.order, df
        return other

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(KEY, CHUNK)

    @property
    def _window(self):
        return Window.partitionBy(KEY, CHUNK).orderBy(*self.order)

    @property
    def _chunks(self):
        return Window.partitionBy(KEY).orderBy(CHUNK)

    @property
    def _earlier_chunks(self):
        return self._chunks.rowsBetween(Window.unboundedPreceding, -1)

    def with_column(self, name: str, value: Column) -> Ordered:
        return self._with(self.df.withColumn(name, value))

    def lead(self, value: str, alias: str) -> Ordered:
        """Value of the next row of the same key, null on the last one."""
        out = self.df.withColumn(alias, F.lead(F.struct(value)).over(self._window))
        first = F.min(F.struct(*self.order, F.struct(F.col(value)).alias("_v"))).alias("_first")
        out = _attach(out, _carried(self.df, [first], F.lead("_first").over(self._chunks).getField("_v")))
        return self._with(out.withColumn(alias, F.coalesce(F.col(alias), F.col("_carry")).getField(value)).drop("_carry"))

    def last(self, value: str, alias: str, include_current: bool = True) -> Ordered:
        """Latest non-null ``value`` at or before each row (strictly before when asked)."""
        end = Window.currentRow if include_current else -1
        frame = self._window.rowsBetween(Window.unboundedPreceding, end)
        out = self.df.withColumn(alias, F.last(value, ignorenulls=True).over(frame))
        present = F.col(value).isNotNull()
        held = F.max_by(F.when(present, F.col(value)), F.when(present, F.struct(*self.order))).alias("_held")
        carry = _carried(self.df, [held], F.last("_held", ignorenulls=True).over(self._earlier_chunks))
        out = _attach(out, carry)
        return self._with(out.withColumn(alias, F.coalesce(F.col(alias), F.col("_carry"))).drop("_carry"))

    def running_sum(self, sums: Mapping[str, Column]) -> Ordered:
        """Totals up to and including each row."""
        frame = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = self.df.withColumns({a: F.sum(e).over(frame) for a, e in sums.items()})
        totals = F.struct(*[F.sum(e).alias(a) for a, e in sums.items()]).alias("_totals")
        carried = [F.sum(F.col("_totals").getField(a)).over(self._earlier_chunks).alias(a) for a in sums]
        out = _attach(out, _carried(self.df, [totals], F.struct(*carried)))
        for alias in sums:
            # Null until the first value, like the plain window.
            earlier = F.col("_carry").getField(alias)
            both = F.coalesce(F.col(alias), F.lit(0)) + F.coalesce(earlier, F.lit(0))
            out = out.withColumn(alias, F.when(F.col(alias).isNotNull() | earlier.isNotNull(), both))
        return self._with(out.drop("_carry"))

    def running_max(self, value: str, alias: str) -> Ordered:
        """Greatest non-null ``value`` up to and including each row."""
        frame = self._window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = self.df.withColumn(alias, F.max(value).over(frame))
        carry = _carried(self.df, [F.max(value).alias("_held")], F.max("_held").over(self._earlier_chunks))
        return self._with(_attach(out, carry).withColumn(alias, F.greatest(alias, "_carry")).drop("_carry"))

    def total(self, alias: str, value: Column) -> Ordered:
        """Sum over all rows of the key, on each of them."""
        per_chunk = self.df.groupBy(KEY, CHUNK).agg(F.sum(value).alias("_part"))
        carry = per_chunk.select(
            F.col(KEY).alias("_carry_key"), F.col(CHUNK).alias("_carry_chunk"),
            F.sum("_part").over(Window.partitionBy(KEY)).alias(alias),
        )
        return self._with(_attach(self.df, carry))

    def number(self, alias: str) -> Ordered:
        """1, 2, 3 … within each key."""
        return self.running_sum({alias: F.lit(1).cast("bigint")})
