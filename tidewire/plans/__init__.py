"""The queries of the engine, by name."""

from . import more_queries, relational, scalars, search_queries, stream_queries, transit_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
