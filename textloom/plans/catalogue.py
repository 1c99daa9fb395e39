"""Every registered query of the library with its SQL."""

from __future__ import annotations

from textloom.plans import corpus_queries, text_queries, training_queries, vector_queries  # noqa: F401  they register
from textloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
