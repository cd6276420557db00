"""Inputs, and the queries that are registered."""

from . import catalog_queries, change_queries, load_queries  # noqa: F401
