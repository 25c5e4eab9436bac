"""All queries by name, and the same in DuckDB's SQL."""

from __future__ import annotations

from tidemark.plans import base, feature_queries, governance_queries, ingest_queries, stream_queries  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
