"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from argloom.plans import composite_queries, evaluation_queries, graph_queries, matching_queries, relational_queries, scalar_queries, source_queries, stream_queries, theory_queries  # noqa: F401
from argloom.plans.bindings import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
