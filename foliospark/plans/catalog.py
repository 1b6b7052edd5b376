"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

from foliospark.plans import model_queries, page_queries, part_queries, review_queries, rule_queries, sql_queries, stream_queries, xml_queries  # noqa: F401
from foliospark.plans.tables import ORACLE, QUERIES

FLAGSHIP = "q_problems"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
