"""Registered queries over the given tables, with their SQL counterparts."""

from platewise.catalog import (  # noqa: F401
    activity, agreement, building, corrections, curation, normalization, quality, release, retrieval, sources, sweeps,
)
from platewise.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
