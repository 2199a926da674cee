"""Imports every query module, so that the registry is complete."""

from arrayflow.plans import (  # noqa: F401
    activity_queries, catalog_queries, layout_queries, recovery_queries, rolling_queries, skew_queries, streaming_queries, tensor_queries)
from arrayflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
