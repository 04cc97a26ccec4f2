"""All registered queries."""

from __future__ import annotations

from runwarden.plans import (  # noqa: F401
    behaviour_queries,
    detection_queries,
    enrich_queries,
    evaluation_queries,
    ingest_queries,
    streaming_queries,
    vulnerability_queries,
)
from runwarden.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
