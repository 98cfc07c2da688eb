"""Importing a module of queries registers them; this imports all."""

from . import contract_queries, flow_queries, queries  # noqa: F401
