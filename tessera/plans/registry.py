"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from tessera.plans import answer_queries, code_queries, conversation_queries, filter_queries, memory_queries, metering_queries, retrieval_queries, search_queries, stored_queries, telemetry_queries, text_queries, vector_queries  # noqa: F401
from tessera.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
