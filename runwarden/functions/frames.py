"""Helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps use as they are.

    Spark copies the expression of a column into the filters and projections that use
    it.  For a parsed document that many columns read, that multiplies the parsing and
    the plan.  A generator of one row is a fence for this: the columns are computed
    below it and only referred to above.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
