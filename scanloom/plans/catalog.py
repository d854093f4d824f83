"""All registered queries."""

from scanloom.plans import (  # noqa: F401
    dedup_queries, filter_queries, frame_queries, hierarchy_queries, index_queries, source_queries, stream_queries,
    sync_queries, value_queries,
)
from scanloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
