"""Connected components of a link table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.session import materialize


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every end of a link; component is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then follows labels twice,
    so that long chains shrink geometrically.  A round's labels are written to the shared
    folder; a hub is a skewed join key that adaptive execution splits, and minima are
    combined before the shuffle.  Links with a null end are ignored; none gives no rows.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where(
        "node IS NOT NULL AND other IS NOT NULL AND node <> other"
    )
    both = pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = materialize(both.distinct())
    labels = materialize(
        both.groupBy("node").agg(F.min("other").alias("m")).select(
            "node", F.least("node", "m").alias("component")
        )
    )
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "component")
        held = labels.withColumn("before", F.col("component"))
        fresh = seen.unionByName(held, allowMissingColumns=True).groupBy("node").agg(
            F.max("before").alias("before"), F.min("component").alias("component")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        fresh = fresh.join(jump, "component", "left").select(
            "node", "before", F.least("component", "next").alias("component")
        )
        fresh = materialize(fresh)
        if fresh.where("before <> component").isEmpty():
            return fresh.drop("before")
        labels = fresh.drop("before")
