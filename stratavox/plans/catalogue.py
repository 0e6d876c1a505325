"""All named queries and their SQL twins."""

from __future__ import annotations

from . import extras, files, regions, scalars, summaries  # noqa: F401  register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
