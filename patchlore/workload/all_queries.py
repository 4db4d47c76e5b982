"""Imports every query module so that the registry is full."""

from patchlore.workload import attribution_queries, diff_queries, graph_queries, history_queries, report_queries, review_queries, source_queries, symbol_queries, timeline_queries  # noqa: F401
from patchlore.workload.registry import QUERIES, SQL  # noqa: F401
