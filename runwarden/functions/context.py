"""Runtime-context documents from container inspections.

A missing value is null here; it becomes the word ``missing`` only where a document
is shown.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.hashing import canonical_json
from runwarden.functions.text import last_segment


def _is_secret(flag: Column) -> Column:
    bare = F.lower(F.ltrim(flag, F.lit("-")))
    hit = bare.isin(config.SECRET_FLAG_WORDS)
    for marker in config.SECRET_FLAG_MARKERS:
        hit = hit | F.contains(bare, F.lit(marker))
    return hit


def _value_class(word: Column) -> Column:
    return (
        F.when(F.contains(word, F.lit("://")), "<url>")
        .when(word.rlike(r"^(/|\./|\.\./)"), "<path>")
        .when(word.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), "<integer>")
        .otherwise("<positional>")
    )


def argv_shape(argv: Column) -> Column:
    """Words of a command line reduced to flags and value classes, null for no list.

    The fold carries what the next word is: the value of a secret flag, the value of
    another flag, or a word of its own.
    """
    state = F.struct(
        F.array().cast("array<string>").alias("shape"), F.lit("start").alias("expect")
    )

    def step(seen: Column, word: Column) -> Column:
        name = F.substring_index(word, "=", 1)
        inline = F.length(word) > F.length(name) + 1
        is_flag = word.startswith("-")
        secret = _is_secret(name)
        expect = seen["expect"]
        flag = F.array(
            F.when(secret, "flag:<secret>").otherwise(F.concat(F.lit("flag:"), F.lower(name))),
            F.when(inline & secret, "<secret-value>").when(inline, "<flag-value>"),
        )
        plain = (
            F.when(expect == "secret", "<secret-value>")
            .when(expect == "value", "<flag-value>")
            .otherwise(_value_class(word))
        )
        added = (
            F.when(expect == "start", F.array(F.concat(F.lit("exe:"), last_segment(word))))
            .when(is_flag, flag)
            .otherwise(F.array(plain))
        )
        following = (
            F.when((expect == "start") | ~is_flag | inline, "word").when(secret, "secret").otherwise("value")
        )
        return F.struct(
            F.concat(seen["shape"], F.array_compact(added)).alias("shape"), following.alias("expect")
        )

    return F.aggregate(argv, state, step, lambda end: end["shape"])


def user_class(user: Column) -> Column:
    name = F.lower(F.trim(F.substring_index(user, ":", 1)))
    return F.when(F.length(user) > 0, F.when(name.isin("0", "root"), "root").otherwise("nonroot"))


def network_class(mode: Column) -> Column:
    text = F.lower(F.trim(mode))
    return F.when(
        F.length(mode) > 0,
        F.when(text.isin("host", "none"), text)
        .when(text.isin("bridge", "default"), "bridge")
        .when(text.startswith("container:"), "container")
        .otherwise("user-defined"),
    )


def capability_set(names: Column) -> Column:
    bare = F.transform(names, lambda c: F.regexp_replace(F.upper(c), "^CAP_", ""))
    return F.coalesce(F.array_sort(F.array_distinct(bare)), F.array().cast("array<string>"))


def device_list(devices: Column) -> Column:
    rows = F.transform(
        devices,
        lambda d: F.struct(
            d["PathInContainer"].alias("destination"), F.lower(d["CgroupPermissions"]).alias("permissions")
        ),
    )
    return F.array_sort(F.coalesce(rows, F.slice(rows, 1, 0), F.expr(
        "cast(array() AS array<struct<destination:string,permissions:string>>)"
    )))


def port_list(exposed: Column, bindings: Column) -> Column:
    """Container ports with the scope of their first binding and whether it is fixed."""
    none = F.array().cast("array<string>")
    names = F.array_union(
        F.coalesce(F.map_keys(exposed), none), F.coalesce(F.map_keys(bindings), none)
    )

    def describe(name: Column) -> Column:
        first = F.get(F.try_element_at(bindings, name), F.lit(0))
        ip = F.coalesce(first["HostIp"], F.lit(""))
        port = F.substring_index(name, "/", 1)
        protocol = F.when(F.contains(name, F.lit("/")), F.lower(F.regexp_extract(name, "/(.*)$", 1)))
        scope = (
            F.when(ip.isin("", "0.0.0.0", "::"), "wildcard")
            .when(ip.isin("127.0.0.1", "::1"), "loopback")
            .otherwise("specific")
        )
        fixed = F.when(F.length(F.coalesce(first["HostPort"], F.lit(""))) > 0, "fixed")
        return F.struct(
            F.when(port.rlike(r"^\d+$"), port.cast("int")).alias("container_port"),
            F.when(F.length(protocol) > 0, protocol).otherwise("tcp").alias("protocol"),
            F.when(first.isNotNull(), scope).alias("binding_scope"),
            F.when(first.isNotNull(), F.coalesce(fixed, F.lit("ephemeral")))
            .otherwise("none")
            .alias("host_port_mode"),
        )

    return F.array_sort(F.transform(names, describe))


def mount_list(mounts: Column, tmpfs: Column) -> Column:
    """Mounts with tmpfs destinations folded in; null when mounts are unknown."""
    listed = F.transform(
        mounts,
        lambda m: F.struct(
            m["Destination"].alias("destination"), F.lower(m["Type"]).alias("type"), (~m["RW"]).alias("read_only")
        ),
    )
    temporary = F.transform(
        F.coalesce(F.map_keys(tmpfs), F.array().cast("array<string>")),
        lambda d: F.struct(
            d.alias("destination"), F.lit("tmpfs").alias("type"), F.lit(False).alias("read_only")
        ),
    )
    return F.array_sort(F.concat(listed, temporary))


_PIECE_BYTES = 1_000_000


def _composed_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of at most about a megabyte of text, or one row, composed."""
    for batch in batches:
        for piece in blocks_of(batch, column, _PIECE_BYTES):
            place = piece.schema.get_field_index(column)
            # Arrow's own normalisation leaves decomposed text as it is.
            texts = [unicodedata.normalize("NFC", t.as_py()) if t.is_valid else None for t in piece.column(place)]
            yield piece.set_column(place, piece.schema.field(place), pa.array(texts, piece.column(place).type))


def blocks_of(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text in ``column``, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        after = max(int(np.searchsorted(ends, before + limit, side="right")), first + 1)
        yield batch.slice(first, after - first)
        first = after


def composed(df: DataFrame, column: str) -> DataFrame:
    """Unicode-compose a text column; only rows with text that may change go through Python.

    Below U+0300 every text is composed already (all of these have the quick check value yes in Unicode).
    """
    other = F.col(column).rlike(r"[^\x{0}-\x{2FF}]")
    plain = df.where(~F.coalesce(other, F.lit(False)))
    work = lambda batches: _composed_batches(batches, column)
    return plain.unionByName(df.where(other).mapInArrow(work, df.schema))


def runtime_context(inspection: str) -> Column:
    """Context document of an inspection struct column."""
    config_ = F.col(f"{inspection}.Config")
    host = F.col(f"{inspection}.HostConfig")
    return F.struct(
        F.lit(config.CONTEXT_SCHEMA).alias("schema_version"),
        argv_shape(config_["Entrypoint"]).alias("entrypoint_shape"),
        argv_shape(config_["Cmd"]).alias("command_shape"),
        user_class(config_["User"]).alias("configured_user"),
        host["Privileged"].alias("privileged"),
        host["ReadonlyRootfs"].alias("read_only_rootfs"),
        network_class(host["NetworkMode"]).alias("network_mode"),
        F.struct(
            capability_set(host["CapAdd"]).alias("add"), capability_set(host["CapDrop"]).alias("drop")
        ).alias("capabilities"),
        device_list(host["Devices"]).alias("devices"),
        port_list(config_["ExposedPorts"], host["PortBindings"]).alias("ports"),
        mount_list(F.col(f"{inspection}.Mounts"), host["Tmpfs"]).alias("mounts"),
    )


def context_hash(context: str) -> Column:
    """Hash of a context column; every list in it is already in a fixed order."""
    names = [
        "schema_version", "entrypoint_shape", "command_shape", "configured_user", "privileged",
        "read_only_rootfs", "network_mode", "capabilities", "devices", "ports", "mounts",
    ]
    return F.sha2(canonical_json({n: F.col(f"{context}.{n}") for n in names}), 256)
