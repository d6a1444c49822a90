"""All catalog queries, gathered from the modules that register them."""

from __future__ import annotations

from . import catalog_table_queries, choice_queries, diagnostic_queries, evaluation_queries, intent_queries, label_queries, more_queries, page_queries, picture_queries, rule_queries, stream_queries, text_queries, vector_queries, word_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
