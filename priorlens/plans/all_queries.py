"""Imports every module that registers queries."""

from . import audit_queries, check_queries, graph_queries, search_queries, set_queries, study_queries, text_queries, use_queries  # noqa: F401
