"""All registered queries."""

from logquarry.plans.registry import ORACLES, QUERIES
from logquarry.plans import document_queries, explore_queries, log_queries, model_queries, store_queries, stream_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
