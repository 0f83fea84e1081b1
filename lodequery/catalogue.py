"""All queries of the library with their SQL equivalents."""

from __future__ import annotations

from .plans import comparison_queries, source_queries, text_queries, vector_queries

_ALL = vector_queries.Q | text_queries.Q | comparison_queries.Q | source_queries.Q


def flagship(spark, sf_dir):
    """Vector search with candidates' labels."""
    return vector_queries.flagship(spark, sf_dir)


def queries():
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
