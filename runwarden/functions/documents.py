"""Walks over JSON documents of any shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwarden import config
from runwarden.session import materialize

#: Bookkeeping fields of a captured node, which is a node with a status.
BOOKKEEPING = ("status", "reason")


def _text(value: Column) -> Column:
    """A string as it is, any other value as JSON."""
    return F.when(_is_text(value), F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _row(path: Column, parents: Column, value: Column, is_key: bool, is_text: Column | bool, hidden: bool) -> list[Column]:
    flags = {"is_key": is_key, "is_text": is_text, "hidden": hidden}
    columns = [path.alias("path"), parents.alias("parents"), value.alias("value")]
    return columns + [(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in flags.items()]


def json_walk(df: DataFrame, document: str, *keep: str) -> DataFrame:
    """One row per key and scalar leaf of the JSON text in ``document``.

    Columns: ``keep``, ``path``, ``parents`` (paths above it), ``value``, ``is_key``, ``is_text`` and
    ``hidden``, which marks keys, the bookkeeping fields of a captured node and, with value
    ``unavailable``, a node that could not be captured.  Null and malformed documents have no rows.

    Documents are parsed once and opened level by level as variants; a level is written to the
    checkpoint folder because leaves and the next level come from it.  There are as many levels
    as the deepest document has.
    """
    keep_columns = [F.col(f"_keep.{name}").alias(name) for name in keep]
    kept = F.struct(*keep) if keep else F.lit(None)
    level = df.select(
        kept.alias("_keep"), F.lit("$").alias("path"), F.array().cast("array<string>").alias("parents"),
        F.try_parse_json(F.col(document)).alias("node"),
    ).where("node IS NOT NULL")
    found = []
    while True:
        opened = level.withColumns(
            {
                "fields": F.try_variant_get("node", "$", "map<string,variant>"),
                "items": F.try_variant_get("node", "$", "array<variant>"),
            }
        )
        captured = F.map_contains_key("fields", F.lit("status"))
        lost = captured & (F.try_variant_get(F.try_element_at("fields", F.lit("status")), "$", "string") == "unavailable")
        node, path, parents = F.col("node"), F.col("path"), F.col("parents")
        leaves = opened.where("fields IS NULL AND items IS NULL")
        found.append(leaves.select(*keep_columns, *_row(path, parents, _text(node), False, _is_text(node), False)))
        marks = opened.where(lost)
        found.append(marks.select(*keep_columns, *_row(path, parents, F.lit("unavailable"), False, False, True)))
        inner = F.concat("parents", F.array("path")).alias("parents")
        named = opened.where("fields IS NOT NULL").select(
            "_keep", "path", inner, captured.alias("captured"), F.explode("fields").alias("key", "node")
        )
        named = named.withColumn("path", F.concat("path", F.lit("."), "key"))
        found.append(named.select(*keep_columns, *_row(path, parents, F.col("key"), True, True, True)))
        book = F.col("captured") & F.col("key").isin(*BOOKKEEPING)
        found.append(named.where(book).select(*keep_columns, *_row(path, parents, _text(node), False, _is_text(node), True)))
        listed = opened.where("items IS NOT NULL").select("_keep", "path", inner, F.posexplode("items").alias("index", "node"))
        listed = listed.withColumn("path", F.concat("path", F.lit("["), "index", F.lit("]")))
        columns = ["_keep", "path", "parents", "node"]
        level = materialize(named.where(~book).select(*columns).unionByName(listed.select(*columns)))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def secret_findings(df: DataFrame, document: str, *keep: str) -> DataFrame:
    """(path, marker) of keys and strings that look like secrets; never the value."""
    words = json_walk(df, document, *keep).where("is_text")
    words = words.where(~F.col("value").isin(config.REDACTION_PLACEHOLDERS))
    marker = F.coalesce(
        *[
            F.when(F.contains(F.lower("value"), F.lit(m)), F.lit(m))
            for m in config.ARTIFACT_SECRET_MARKERS
        ]
    )
    return words.select(*keep, "path", marker.alias("marker")).where("marker IS NOT NULL")


def document_diff(left: DataFrame, right: DataFrame, document: str, key: str) -> DataFrame:
    """Paths whose values differ between two documents of the same key.

    Nodes that either side could not capture are skipped with everything below them.
    """
    a, b = (materialize(json_walk(side, document, key)) for side in (left, right))
    lost = a.where("hidden AND value = 'unavailable' AND NOT is_key AND NOT is_text").unionByName(
        b.where("hidden AND value = 'unavailable' AND NOT is_key AND NOT is_text")
    )
    lost = lost.select(key, F.col("path").alias("_lost")).distinct()

    def values(rows: DataFrame, alias: str) -> DataFrame:
        return rows.where("NOT hidden AND NOT is_key").select(
            key, "path", "parents", F.col("value").alias(alias)
        )

    x, y = values(a, "left_value"), values(b, "right_value")
    joined = x.join(y.withColumnRenamed("parents", "_p"), [key, "path"], "full_outer")
    differing = joined.where(~F.col("left_value").eqNullSafe(F.col("right_value"))).select(
        key, "path", F.coalesce("parents", "_p").alias("parents"), "left_value", "right_value"
    )
    inside = differing.select(key, "path", F.explode(F.concat("parents", F.array("path"))).alias("_lost"))
    skipped = inside.join(lost, [key, "_lost"], "left_semi").select(key, "path").distinct()
    return differing.join(skipped, [key, "path"], "left_anti").drop("parents")


def path_text(column: Column) -> Column:
    """Path without the root sign, for display."""
    return F.regexp_replace(column, r"^\$\.?", "")
