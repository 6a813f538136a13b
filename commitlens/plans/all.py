"""Imports every module that registers queries."""

from . import graph_queries, label_queries, lookup_queries, text_queries  # noqa: F401
