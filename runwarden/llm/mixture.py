"""Training mixture of executions from several hosts, along a curriculum of weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TIMES = 3
BASE_WEIGHTS = (1, 2, 3)
#: Slices of a source in hash order; running sums are made within a slice and carried between them.
SLICES = 4096
#: Weight of a source along the curriculum: it grows linearly from ``1 - tilt`` to ``1 + tilt``
#: times its mean, and the tilts of the sources go in a circle.
TILTS = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, base_weights: Sequence[int] = BASE_WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Target of every source: a share of all sizes by weight, at most ``most_times`` its size.

    ``sizes``: ``docker_host_id, source_size``, one row per source.  Adds ``weight, rank, target``.
    What a source may not take is shared again by weight among the others.  A source is at its
    limit exactly if its limit per weight is at most what is left per weight for it and all sources
    with a higher limit per weight, so one ordered pass finds all; the first source that is not
    at its limit has the final level.
    """
    by_name = Window.orderBy(F.col("docker_host_id").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in base_weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(weights, (F.col("rank") % len(base_weights) + 1).cast("int"))
    )
    ratio = F.col("source_size") / F.col("weight")
    lower = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "level",
        (F.col("total") - most_times * F.coalesce(F.sum("source_size").over(lower), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0))),
    )
    limited = most_times * F.col("source_size") <= F.col("level") * F.col("weight")
    level = F.max(F.when(~limited, F.col("level"))).over(everything)
    target = F.when(limited, (most_times * F.col("source_size")).cast("double")).otherwise(level * F.col("weight"))
    return left.withColumn("target", target).select("docker_host_id", "source_size", "rank", "weight", "target")


def curriculum_position(share: Column, tilt: Column) -> Column:
    """Time in [0, 1] at which a source has given ``share`` of its words.

    The weight 1 + tilt (2 t - 1) integrates to t + tilt (t^2 - t); the position is the inverse.
    """
    b = 1 - tilt
    root = F.sqrt(F.greatest(b * b + 4 * tilt * share, F.lit(0.0)))
    return F.when(F.abs(tilt) < 1e-12, share).otherwise(2 * share / (b + root))


def mix_executions(
    executions: DataFrame,
    base_weights: Sequence[int] = BASE_WEIGHTS,
    most_times: int = MOST_TIMES,
    tilts: Sequence[float] = TILTS,
) -> DataFrame:
    """Which executions a training mixture takes, how often, and where in the curriculum.

    ``executions``: ``event_id, docker_host_id, command_line``.  Returns a row for each, in
    range-sorted order of ``position``: ``event_id, docker_host_id, size`` (words),
    ``source_size, target, copies, taken`` (words, repeats counted) and ``position`` (of the
    first copy, null when not taken).

    Method: sources weigh ``base_weights`` in turn by code point, null last.  A source is read in
    hash order again and again up to its target; an execution is taken in the last, partial
    reading if more than half of it lies below the target.  So a source misses its target by
    less than one execution and none is taken more than ``most_times`` times.  Over the curriculum
    the weight of a source changes linearly; the position of a copy is the time at which the
    integral of the weight reaches the copy's place in the source's demand.

    A source is cut into slices by hash, running sums are made within a slice, and sums of whole
    slices are carried, so no task holds a source.  The order depends on ids, sizes and sources
    only, so reruns agree.

    Defined cases: null or blank text has size 0 and takes 0 words; a null source is a source of
    its own; repeated rows are mixed like others, rows equal in id and size being
    interchangeable; null ids are allowed; an empty table gives no rows; other columns are ignored.
    """
    words = F.coalesce(F.regexp_count("command_line", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    digest = F.md5(F.coalesce(F.col("event_id").cast("string"), F.lit("")))
    slice_of = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    rows = executions.select("event_id", "docker_host_id", words.alias("size"), digest.alias("_place"), slice_of.alias("_slice"))

    per_slice = rows.groupBy("docker_host_id", "_slice").agg(F.sum("size").alias("_sum"))
    sizes = per_slice.groupBy("docker_host_id").agg(F.sum("_sum").alias("source_size"))
    earlier = Window.partitionBy("docker_host_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.withColumn("_carry", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    targets = source_targets(sizes, base_weights, most_times)
    same = carried["docker_host_id"].eqNullSafe(targets["docker_host_id"])
    starts = carried.join(targets, same).select(
        carried["docker_host_id"].alias("_host"), F.col("_slice").alias("_part"), "_carry", "source_size", "target", "rank"
    )

    within = Window.partitionBy("docker_host_id", "_slice").orderBy("_place", "size", "event_id")
    inside = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_inside", inside)
    on = placed["docker_host_id"].eqNullSafe(starts["_host"]) & (placed["_slice"] == starts["_part"])
    joined = placed.join(starts, on)

    start = F.col("_carry") + F.col("_inside")
    whole = F.floor(F.try_divide("target", "source_size"))
    rest = F.col("target") - whole * F.col("source_size")
    last = F.when(2 * start + F.col("size") < 2 * rest, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(whole + last, F.lit(most_times)).cast("bigint")).otherwise(F.lit(0))
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), (F.col("rank") % len(tilts) + 1).cast("int"))
    share = F.least(F.try_divide(start + F.col("size") / 2, F.col("target")), F.lit(1.0))
    out = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    out = out.withColumn("position", F.when(F.col("copies") > 0, curriculum_position(share, tilt)))
    result = out.select(
        "event_id", "docker_host_id", "size", "source_size", "target", "copies", "taken", "position"
    )
    return result.repartitionByRange("position", "event_id").sortWithinPartitions("position", "event_id")


def training_order(mixed: DataFrame, tilts: Sequence[float] = TILTS) -> DataFrame:
    """A row for every copy with its own ``position``, range-sorted: the order of training.

    ``mixed``: result of ``mix_executions`` with its copies; later copies come one reading of
    the source later.
    """
    by_name = Window.orderBy(F.col("docker_host_id").asc_nulls_last())
    names = mixed.groupBy("docker_host_id").agg(F.max("target").alias("_t")).withColumn(
        "_rank", F.row_number().over(by_name) - 1
    )
    tilt = F.element_at(F.array(*[F.lit(float(t)) for t in tilts]), (F.col("_rank") % len(tilts) + 1).cast("int"))
    rows = mixed.where("copies > 0").join(names.withColumnRenamed("docker_host_id", "_host"), mixed["docker_host_id"].eqNullSafe(F.col("_host")))
    first = F.col("position") + tilt * (F.col("position") * F.col("position") - F.col("position"))
    copy = F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))
    rows = rows.select("event_id", "docker_host_id", "size", "source_size", "target", first.alias("_first"), tilt.alias("_tilt"), copy.alias("copy"))
    share = F.least(F.col("_first") + F.col("copy") * F.col("source_size") / F.col("target"), F.lit(1.0))
    rows = rows.withColumn("position", curriculum_position(share, F.col("_tilt")))
    return rows.drop("_first", "_tilt").repartitionByRange("position", "event_id").sortWithinPartitions("position", "event_id")
