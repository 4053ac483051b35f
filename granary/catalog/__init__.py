"""Registered queries on the test tables, each next to its SQL oracle."""

from granary.catalog import (  # noqa: F401
    analyses,
    enrichment,
    estimates,
    joining,
    landing,
    network,
    projection,
    reshaping,
    samples,
    scalars,
    summaries,
    topics,
)
from granary.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
