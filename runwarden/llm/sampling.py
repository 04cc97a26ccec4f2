"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS, _BUCKET_BITS = 32, 12
SAMPLE_BYTES = 24_000_000
#: A text above this share of the bytes is taken only where there is nothing else.
LARGE_SHARE = 8


def bounded_sample(rows: DataFrame, text: str, most: int, most_bytes: int = SAMPLE_BYTES, by: str | None = None) -> DataFrame:
    """At most ``most`` rows, chosen by the hash of their text; the same ones in every run.

    With ``by`` its values (few) have equal shares of ``most``; each has ``most_bytes`` of text.
    Texts above an eighth of these bytes come last, so one long text does not displace the
    others.  There is a row for every value that has one.  A histogram of the hashes tells up
    to which hash enough rows are found, so that only about ``most`` rows are ordered; of
    copies of one text each task sends at most ``most``.
    """
    group = F.col(by) if by else F.lit(0)
    place = F.shiftrightunsigned(F.xxhash64(text, F.lit(7)), 64 - _BITS)
    hashed = rows.withColumns({"_group": group, "_place": place})
    bucket = F.shiftright("_place", _BITS - _BUCKET_BITS)
    found: dict[object, dict[int, int]] = {}
    # At most 2 ** _BUCKET_BITS rows for each group.
    for row in hashed.groupBy("_group", bucket.alias("bucket")).count().collect():
        found.setdefault(row["_group"], {})[row["bucket"]] = row["count"]
    share = max(1, most // max(len(found), 1))
    few = F.lit(False)
    for value, counts in found.items():
        total, bound = 0, 0
        for at in sorted(counts):
            total, bound = total + counts[at], at + 1
            if total >= 1.2 * share:
                break
        few = few | (F.col("_group").eqNullSafe(F.lit(value)) & (F.col("_place") < F.lit(bound << (_BITS - _BUCKET_BITS))))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    order = Window.partitionBy("_group").orderBy("_large", "_place", text)
    sized = hashed.where(few).withColumns({"_size": size, "_large": size > most_bytes // LARGE_SHARE})
    first = sized.withColumn("_number", F.row_number().over(order)).where(F.col("_number") <= share)
    before = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    read = first.withColumn("_before", F.coalesce(before, F.lit(0)))
    kept = read.where((F.col("_number") == 1) | (F.col("_before") + F.col("_size") <= most_bytes))
    return kept.drop("_group", "_place", "_size", "_large", "_number", "_before")
