"""All queries of the engine by name, with the SQL that DuckDB runs for each."""

from __future__ import annotations

from millrace.plans import analytics_queries, cluster_queries, incremental_queries, ingest_queries, retrieval_queries, text_queries, thread_queries  # noqa: F401  they register their queries
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
