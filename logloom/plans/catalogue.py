"""All registered queries of the log-analytics operators, with their SQL."""

from __future__ import annotations

from logloom.plans import aggregate_queries, dataset_queries, detect_queries, evaluate_queries, investigate_queries, join_queries, report_queries, sequence_queries, source_queries, text_queries  # noqa: F401
from logloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
