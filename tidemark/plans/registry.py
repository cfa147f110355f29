"""Every registered query of the library, with its SQL for comparison."""

from __future__ import annotations

from functools import wraps

from tidemark.plans import alert_queries, dataset_queries, history_queries, ingest_queries, more_queries, quality_queries, stream_queries, window_queries, write_queries
from tidemark.plans.session import ready
from tidemark.plans.views import plain

MODULES = (window_queries, history_queries, quality_queries, alert_queries, dataset_queries, more_queries, stream_queries, write_queries, ingest_queries)


def _plain(query):
    return ready(wraps(query)(lambda spark, sf_dir: plain(query(spark, sf_dir))))


def queries() -> dict:
    return {k: _plain(f) for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
