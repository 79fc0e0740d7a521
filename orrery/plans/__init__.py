"""All queries of the engine, by name, and SQL for them."""

from . import graph_queries, program_queries, source_queries, text_queries  # noqa: F401  each adds its queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
