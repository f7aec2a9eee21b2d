"""All queries of the engine by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import change_queries, graph_queries, language_queries, relational, tpch

QUERIES: dict[str, tuple] = {**relational.QUERIES, **graph_queries.QUERIES, **tpch.QUERIES, **change_queries.QUERIES, **language_queries.QUERIES}
