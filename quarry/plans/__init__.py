"""The library's operators, readers and functions bound to the driver's tables, each query with its SQL."""

from quarry.plans import branch_queries, feed_queries, function_queries, report_queries, source_queries, storage_queries  # noqa: F401  each adds its queries
from quarry.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
