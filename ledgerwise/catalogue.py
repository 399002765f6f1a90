"""Driver queries of the billing library and the SQL each is held against."""

from __future__ import annotations

from .plans import index_queries, model_queries, peer_queries, record_queries, review_queries, serving_queries, stream_queries  # noqa: F401  they register themselves
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
