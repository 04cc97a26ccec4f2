"""Registered queries and, where SQL can say it, the query that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runwarden.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``function(tables) -> DataFrame`` under a name."""

    def register(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder))

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return register
