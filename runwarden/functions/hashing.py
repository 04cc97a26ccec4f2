"""Canonical JSON hashes and hash-based assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from runwarden import config


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON object with sorted keys; nulls are written out."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def sha256_fields(fields: Mapping[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def sorted_map(value: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def assign_split(identifier: Column, splits: Sequence[str] = tuple(config.SPLITS)) -> Column:
    """Split of a whole run, from the first eight bytes of the hash of its id."""
    head = F.conv(F.substring(F.sha2(identifier, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    slot = (head % F.lit(len(splits)).cast("decimal(20,0)")).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in splits]), slot + 1)


def set_digest_parts(identifier: Column) -> list[Column]:
    """Mergeable fingerprint of a set of ids: four exact sums of hash slices.

    Unlike a hash over the sorted list, this can be computed with partial
    aggregation, so one huge group never has to meet in one task.
    """
    digest = F.sha2(identifier, 256)
    return [
        F.sum(
            F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
        ).alias(f"part{i}")
        for i in range(4)
    ]
