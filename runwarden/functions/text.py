"""Cleaning, clipping and redaction of strings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runwarden import config


def clean(value: Column) -> Column:
    """Placeholder spellings of "no value" become null."""
    return F.when(~value.isin(config.NA_VALUES), value)


def clip(value: Column, length: int | None = None) -> Column:
    cleaned = clean(value.cast("string"))
    return cleaned if length is None else F.substring(cleaned, 1, length)


def non_negative_int(value: Column) -> Column:
    """Integer text to BIGINT; anything else, and negatives, become null."""
    text = F.trim(clean(value.cast("string")))
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    return F.when(number >= 0, number)


def token(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.lit(config.UNKNOWN))


def blank_to_null(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(F.length(trimmed) > 0, trimmed)


def basename(value: Column) -> Column:
    """Last path component; a trailing slash does not count as one."""
    return F.regexp_extract(value, r"([^/]*)/*$", 1)


def last_segment(value: Column) -> Column:
    """Text after the last slash, which may be empty."""
    return F.substring_index(value, "/", -1)


def redact(value: Column) -> Column:
    """Blank out secrets in a line; the patterns run in a fixed order."""
    return reduce(
        lambda column, rule: F.regexp_replace(column, rule[0], rule[1]), config.REDACTIONS, value
    )


def clip_utf8(value: Column, max_bytes: int) -> Column:
    """First ``max_bytes`` bytes of the UTF-8 form without a broken last character.

    A UTF-8 character has at most four bytes, so one of the four cuts is valid.
    """
    data = F.encode(value, "UTF-8")
    cuts = [
        F.try_validate_utf8(F.substring(data, 1, max(0, max_bytes - i)).cast("string"))
        for i in range(4)
    ]
    return F.when(F.octet_length(value) <= max_bytes, value).otherwise(F.coalesce(*cuts))


def image_reference(repository: Column, tag: Column) -> Column:
    return F.when(
        repository.isNotNull() & tag.isNotNull(), F.concat_ws(":", repository, tag)
    ).otherwise(repository)


def tag_list(tags: Column) -> Column:
    """Non-placeholder tags, all of them and whole."""
    kept = F.filter(tags, lambda t: t.isNotNull() & ~t.isin(config.NA_VALUES))
    return F.coalesce(kept, F.array().cast("array<string>"))


def action_category(action: Column) -> Column:
    head = F.trim(F.substring_index(F.lower(F.trim(action)), ":", 1))
    named = F.when(F.length(head) > 0, head).otherwise(F.lit("unknown"))
    return F.coalesce(named, F.lit("unknown"))


def action_detail(action: Column) -> Column:
    """Trimmed text after the first colon, null when there is none."""
    rest = F.regexp_extract(action, r"(?s)^[^:]*:(.*)$", 1)
    return blank_to_null(rest)


def canonical_repository(reference: Column) -> Column:
    """Repository name without digest, tag and default registry prefixes."""
    bare = F.substring_index(reference, "@", 1)
    untagged = F.regexp_replace(bare, r":[^/:]*$", "")
    return F.regexp_replace(F.regexp_replace(untagged, r"^docker\.io/", ""), r"^library/", "")


def primary_digest(image_ref: Column, repo_digests: Column) -> Column:
    """First pinned digest of the image's own repository, else the first pinned one."""
    pinned = F.array_sort(
        F.array_distinct(F.filter(repo_digests, lambda d: F.instr(d, "@sha256:") > 0))
    )
    wanted = canonical_repository(image_ref)
    own = F.filter(pinned, lambda d: canonical_repository(d) == wanted)
    return F.coalesce(F.get(own, F.lit(0)), F.get(pinned, F.lit(0)))
