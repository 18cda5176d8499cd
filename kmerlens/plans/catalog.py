"""All queries of the library; importing the modules registers them."""

from __future__ import annotations

from . import count_queries, interval_queries, ranking_queries, report_queries, screen_queries, sequence_queries, source_queries, sql_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
