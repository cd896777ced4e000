"""Registered queries over the test tables, each with its SQL counterpart where SQL can say it."""

from workload.registry import ORACLES, QUERIES
from workload import metric_queries, model_queries, report_queries, source_queries, split_queries, window_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
