"""Which program an event really ran."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runwarden import config
from runwarden.functions.text import basename


def _applet(command_line: Column) -> Column:
    """Second word of the command line as a program name; null for flags."""
    words = F.split(F.trim(command_line), r"\s+")
    name = F.lower(basename(F.get(words, F.lit(1))))
    return F.when((F.length(name) > 0) & ~name.startswith("-"), name)


def _is_multicall(path: Column) -> Column:
    return F.lower(basename(path)).isin(config.MULTICALL_BINARIES)


def _multicall_name(name: Column, command_line: Column) -> Column:
    """Applet behind a multi-call binary, null when nothing names one."""
    lowered = F.lower(name)
    own = F.when((F.length(lowered) > 0) & ~lowered.isin(config.MULTICALL_BINARIES), lowered)
    generic = F.when(F.length(lowered) > 0, lowered)
    return F.coalesce(own, _applet(command_line), generic)


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def program_name(executable: Column, name: Column, command_line: Column) -> Column:
    """Lower-case base name used by the rules, '' when nothing is known."""
    path, short = _text(executable), _text(name)
    base = F.lower(basename(path))
    plain = F.when(F.length(base) > 0, base).otherwise(F.lower(short))
    return F.when(
        _is_multicall(path), F.coalesce(_multicall_name(short, command_line), plain)
    ).otherwise(plain)


def program_path(executable: Column, name: Column, command_line: Column) -> Column:
    """Display form: applet, else full path, else name, else ``<unknown>``."""
    path, short = _text(executable), _text(name)
    plain = F.coalesce(
        F.when(F.length(path) > 0, path),
        F.when(F.length(short) > 0, short),
        F.lit(config.UNKNOWN),
    )
    return F.when(
        _is_multicall(path), F.coalesce(_multicall_name(short, command_line), plain)
    ).otherwise(plain)


def parent_path(executable: Column, name: Column, command_line: Column) -> Column:
    path = program_path(executable, name, command_line)
    return F.when(path != config.UNKNOWN, path)


def baseline_lookup(executable: Column, name: Column, command_line: Column) -> Column:
    """Struct (path, name) to look up in a baseline; path is null for multi-call binaries."""
    path, short = _text(executable), F.lower(_text(name))
    multicall = _is_multicall(path)
    return F.struct(
        F.when(~multicall & (F.length(path) > 0), path).alias("path"),
        F.when(multicall, _multicall_name(short, command_line))
        .when(F.length(short) > 0, short)
        .alias("name"),
    )
