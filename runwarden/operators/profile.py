"""Behaviour profiles: token distributions, sequence bigrams, window numerics.

Table shapes
------------
execs      image_digest, container_id, event_id, occurred_at, process_name,
           executable, parent_name, parent_executable, user_uid
lifecycle  image_digest, container_id, event_id, occurred_at, event_type, action
tokens     image_digest, <segment>, family, token, n

The raw events are read once and leave the map side as counts per
(digest, window, family, token).  Baselines, observations and the per-window
numbers are all derived from that much smaller table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from runwarden import config
from runwarden.functions.hashing import set_digest_parts
from runwarden.functions.text import last_segment, token
from runwarden.operators import quantiles
from runwarden.operators.ordering import Ordered

SHELL_FAMILY = "_shell"


def micros(at: Column) -> Column:
    return F.unix_micros(at)


def window_index(
    at_us: Column, start_us: int | Column, window_us: int | Column, end_us: int | Column | None = None
) -> Column:
    """Index of the fixed window that holds a time, anchored at ``start_us``.

    Times before the anchor fall into the first window; with ``end_us`` times
    after the end fall into the last one.
    """
    start = start_us if isinstance(start_us, Column) else F.lit(start_us)
    width = window_us if isinstance(window_us, Column) else F.lit(window_us)
    index = F.greatest(F.floor((at_us - start) / width), F.lit(0)).cast("bigint")
    if end_us is None:
        return index
    end = end_us if isinstance(end_us, Column) else F.lit(end_us)
    count = F.greatest(F.ceil((end - start) / width), F.lit(1)).cast("bigint")
    return F.least(index, count - 1)


def process_token() -> Column:
    path = F.when(F.length("executable") > 0, F.col("executable"))
    return token(F.coalesce(path, F.col("process_name")))


def parent_token() -> Column:
    path = F.when(F.length("parent_executable") > 0, F.col("parent_executable"))
    return token(F.coalesce(path, F.col("parent_name")))


def is_baseline_shell() -> Column:
    """Shell by process name or by the base name of the executable."""
    return F.lower(F.coalesce("process_name", F.lit(""))).isin(config.BASELINE_SHELLS) | F.lower(
        last_segment(process_token())
    ).isin(config.BASELINE_SHELLS)


def _pair(family: str, value: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), value.alias("token"))


def exec_token_pairs() -> list[Column]:
    """The (family, token) features of one execution."""
    uid = F.coalesce(F.col("user_uid").cast("string"), F.lit(config.UNKNOWN))
    return [
        _pair("process_name", token(F.col("process_name"))),
        _pair("executable", process_token()),
        _pair("parent_child", F.concat_ws(" -> ", parent_token(), process_token())),
        _pair("user_uid", uid),
    ]


def exec_tokens(execs: DataFrame, keys: Sequence[str], with_shell: bool = False) -> DataFrame:
    """One (family, token) row per feature of an execution, counted per key."""
    pairs = exec_token_pairs()
    if with_shell:
        pairs.append(_pair(SHELL_FAMILY, is_baseline_shell().cast("string")))
    exploded = execs.select(*keys, F.inline(F.array(*pairs)))
    return exploded.groupBy(*keys, "family", "token").agg(F.count(F.lit(1)).alias("n"))


def lifecycle_tokens(lifecycle: DataFrame, keys: Sequence[str]) -> DataFrame:
    label = F.concat_ws(":", "event_type", "action").alias("token")
    rows = lifecycle.select(*keys, F.lit("runtime_action").alias("family"), label)
    return rows.groupBy(*keys, "family", "token").agg(F.count(F.lit(1)).alias("n"))


def token_counts(execs: DataFrame, lifecycle: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of every token family except the sequence bigrams."""
    return exec_tokens(execs, keys).unionByName(lifecycle_tokens(lifecycle, keys))


def sequence_bigrams(execs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of adjacent executables per container; pairs never cross containers or keys."""
    rows = execs.where(F.length("container_id") > 0).select(
        *keys,
        "container_id",
        F.col("occurred_at").alias("_at"),
        F.col("event_id").alias("_id"),
        process_token().alias("_token"),
    )
    group = [*[k for k in keys if k != "container_id"], "container_id"]
    paired = Ordered(rows, group, ["_at", "_id"]).lead("_token", "_next").rows
    bigrams = paired.where(F.col("_next").isNotNull()).select(
        *keys,
        F.lit("process_sequence_bigram").alias("family"),
        F.concat_ws(" -> ", "_token", "_next").alias("token"),
    )
    return bigrams.groupBy(*keys, "family", "token").agg(F.count(F.lit(1)).alias("n"))


def distribution(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each token within (key, family), rounded to 12 digits."""
    totals = tokens.groupBy(*keys, "family").agg(F.sum("n").alias("total"))
    return tokens.join(totals, [*keys, "family"]).select(
        *keys, "family", "token", "n", F.round(F.col("n") / F.col("total"), 12).alias("p")
    )


def observed_sets(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct tokens per key and family, as rows."""
    return tokens.select(*keys, "family", "token").distinct()


# --- fixed windows -----------------------------------------------------------------------


def windowed_counts(execs: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Token counts per (digest, window ``w``) in one pass over each event table."""
    keys = ["image_digest", "w"]
    return exec_tokens(execs, keys, with_shell=True).unionByName(lifecycle_tokens(lifecycle, keys))


def window_numbers(counts: DataFrame, window_us: int) -> DataFrame:
    """Numbers of each non-empty (digest, window) from its token counts."""
    n = F.col("n")

    def total(family: str, condition: Column | None = None) -> Column:
        hit = F.col("family") == family
        if condition is not None:
            hit = hit & condition
        return F.coalesce(F.sum(F.when(hit, n)), F.lit(0))

    execs = total("executable")
    sums = counts.groupBy("image_digest", "w").agg(
        execs.alias("exec_count"),
        total("runtime_action").alias("lifecycle_count"),
        F.count_if(F.col("family") == "executable").alias("distinct_processes"),
        total("user_uid", F.col("token") == "0").alias("root_count"),
        total(SHELL_FAMILY, F.col("token") == "true").alias("shell_count"),
    )
    return _ratios(sums, window_us)


def _ratios(sums: DataFrame, window_us: int) -> DataFrame:
    minutes = window_us / 60_000_000

    def ratio(part: str) -> Column:
        return F.when(F.col("exec_count") > 0, F.col(part) / F.col("exec_count")).otherwise(0.0)

    return sums.select(
        "image_digest",
        "w",
        "exec_count",
        "lifecycle_count",
        (F.col("exec_count") / minutes).alias("process_events_per_minute"),
        (F.col("lifecycle_count") / minutes).alias("runtime_events_per_minute"),
        F.col("distinct_processes").cast("double").alias("distinct_processes_per_window"),
        ratio("root_count").alias("root_process_ratio"),
        ratio("shell_count").alias("shell_process_ratio"),
    )


def window_spine(digests: DataFrame, first: int, count: int) -> DataFrame:
    """Every window of every digest, so that empty windows are not lost."""
    bounds = [F.lit(x).cast("bigint") for x in (first, first + count - 1)]
    indices = F.explode(F.sequence(*bounds))
    return digests.select("image_digest").distinct().select("image_digest", indices.alias("w"))


def fill_windows(numbers: DataFrame, spine: DataFrame) -> DataFrame:
    """Numbers for every window of the spine, zero where nothing happened."""
    joined = spine.join(numbers, ["image_digest", "w"], "left")
    return joined.fillna(0, [c for c in numbers.columns if c not in ("image_digest", "w")])


def numeric_summary(filled: DataFrame) -> DataFrame:
    """min, max, mean, median, nearest-rank p95 and population deviation per feature."""
    features = list(config.NUMERIC_WEIGHTS)
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]
    )
    rows = filled.select("image_digest", F.inline(pairs))
    value, keys = F.col("value"), ["image_digest", "feature"]
    shape = rows.groupBy(*keys).agg(
        F.round(F.min(value), 12).alias("min"),
        F.round(F.max(value), 12).alias("max"),
        F.round(F.avg(value), 12).alias("mean"),
        F.round(F.stddev_pop(value), 12).alias("stddev"),
    )
    running = quantiles.running_counts(quantiles.value_counts(rows, keys, "value"), keys, "value")
    ranks = running.groupBy(F.col("image_digest").alias("_digest"), F.col("feature").alias("_feature")).agg(
        F.round(quantiles.median("value"), 12).alias("median"),
        F.round(quantiles.nearest_rank(0.95, "value"), 12).alias("p95"),
    )
    same = F.col("image_digest").eqNullSafe(F.col("_digest")) & (F.col("feature") == F.col("_feature"))
    return shape.join(ranks, same).select(*keys, "min", "max", "mean", "median", "p95", "stddev")


# --- manifest, quality, identity of an event set -----------------------------------------


def profile_manifest(execs: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Counts, containers and time range of the events behind a profile, per digest."""
    columns = ["image_digest", "container_id", "occurred_at"]
    both = execs.select(*columns, F.lit(True).alias("is_exec")).unionByName(
        lifecycle.select(*columns, F.lit(False).alias("is_exec"))
    )
    by_container = both.groupBy(
        "image_digest", F.when(F.length("container_id") > 0, F.col("container_id")).alias("c")
    ).agg(*_counts_and_times("is_exec", "occurred_at"))
    return by_container.groupBy("image_digest").agg(
        F.sum("process_event_count").alias("process_event_count"),
        F.sum("runtime_event_count").alias("runtime_event_count"),
        F.count("c").alias("container_count"),
        F.min("first_process_at").alias("first_process_at"),
        F.max("last_process_at").alias("last_process_at"),
        F.min("first_runtime_at").alias("first_runtime_at"),
        F.max("last_runtime_at").alias("last_runtime_at"),
    )


def _counts_and_times(flag: str, at: str) -> list[Column]:
    is_exec = F.col(flag)
    when_exec, when_runtime = F.when(is_exec, F.col(at)), F.when(~is_exec, F.col(at))
    return [
        F.count_if(is_exec).alias("process_event_count"),
        F.count_if(~is_exec).alias("runtime_event_count"),
        F.min(when_exec).alias("first_process_at"),
        F.max(when_exec).alias("last_process_at"),
        F.min(when_runtime).alias("first_runtime_at"),
        F.max(when_runtime).alias("last_runtime_at"),
    ]


def quality_gate(
    manifest: DataFrame,
    numbers: DataFrame,
    bigrams: DataFrame,
    min_process_events: int,
    min_nonempty_windows: int,
) -> DataFrame:
    """Checks and warnings that decide whether a profile may be activated."""
    windows = numbers.groupBy("image_digest").agg(F.count(F.lit(1)).alias("nonempty_windows"))
    pairs = bigrams.groupBy("image_digest").agg(F.count(F.lit(1)).alias("bigram_count"))
    joined = manifest.join(windows, "image_digest", "left").join(pairs, "image_digest", "left")
    joined = joined.fillna(0, ["nonempty_windows", "bigram_count"])
    enough_events = F.col("process_event_count") >= min_process_events
    enough_windows = F.col("nonempty_windows") >= min_nonempty_windows
    has_digest = F.coalesce(F.length("image_digest") > 0, F.lit(False))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("container_count") < 2, F.lit("few_containers")),
            F.when(F.col("runtime_event_count") == 0, F.lit("no_lifecycle_events")),
            F.when(F.col("bigram_count") == 0, F.lit("no_sequence_bigrams")),
        )
    )
    return joined.select(
        "image_digest",
        "process_event_count",
        "nonempty_windows",
        enough_events.alias("enough_process_events"),
        enough_windows.alias("enough_windows"),
        has_digest.alias("has_digest"),
        (enough_events & enough_windows & has_digest).alias("passed"),
        warnings.alias("warnings"),
    )


def labelled_ids(execs: DataFrame, lifecycle: DataFrame, keys: Sequence[str]) -> DataFrame:
    return execs.select(*keys, F.concat(F.lit("process:"), "event_id").alias("id")).unionByName(
        lifecycle.select(*keys, F.concat(F.lit("runtime:"), "event_id").alias("id"))
    )


def event_set_fingerprint(ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of the id set of each key, fully mergeable."""
    parts = set_digest_parts(F.col("id"))
    names = [f"part{i}" for i in range(len(parts))]
    sums = ids.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), *parts)
    text = F.concat_ws(":", F.col("event_count").cast("string"), *[F.col(n).cast("string") for n in names])
    return sums.select(*keys, "event_count", F.sha2(text, 256).alias("event_set_fingerprint"))


#: Hexadecimal digits of an id's SHA-256 that name its bucket: 256 buckets for each set.
BUCKET_DIGITS = 2


def event_set_hash(ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merkle digest of the id set of each key, next to the mergeable fingerprint.

    An id belongs to the bucket named by the first digits of its own SHA-256.  A bucket's digest is
    the SHA-256 of its sorted ids, joined by newlines; the set's digest is that of the lines
    ``bucket:digest`` of its buckets in order.  Buckets of one key are sorted and digested by
    different tasks, which stream over their ids in constant memory; only the bounded list of
    bucket digests meets.  Null ids belong to no set.
    """
    keys = list(keys)
    held = [*keys, "_bucket"]
    schema = StructType([*ids.select(*keys).schema, StructField("_bucket", StringType()), StructField("_digest", StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[list] = []
        for batch in batches:
            rows = zip(zip(*[batch.column(k).to_pylist() for k in held]), batch.column("id").to_pylist())
            for key, members in groupby(rows, key=itemgetter(0)):
                block = "\n".join(one[1] for one in members).encode()
                if state is not None and key == current:
                    state.update(b"\n" + block)
                    continue
                if state is not None:
                    done.append([*current, state.hexdigest()])
                current, state = key, hashlib.sha256(block)
            if len(done) >= 10_000:
                yield _record(done, kinds, schema.names)
                done = []
        if state is not None:
            yield _record([*done, [*current, state.hexdigest()]], kinds, schema.names)

    bucket = F.substring(F.sha2("id", 256), 1, BUCKET_DIGITS).alias("_bucket")
    ordered = ids.where(F.col("id").isNotNull()).select(*keys, bucket, "id")
    ordered = ordered.repartition(*held).sortWithinPartitions(*held, "id")
    lines = F.collect_list(F.concat_ws(":", "_bucket", "_digest"))  # at most 16 ** BUCKET_DIGITS
    whole = F.sha2(F.array_join(F.array_sort(lines), "\n"), 256).alias("event_set_sha256")
    exact = ordered.mapInArrow(digests, schema).groupBy(*keys).agg(whole)
    return event_set_fingerprint(ids, keys).join(exact, keys, "left")


def _record(rows: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
