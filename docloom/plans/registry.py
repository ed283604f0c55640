"""All registered queries by name, and the DuckDB text that each must equal."""

from . import item_queries, store_queries, stream_queries  # noqa: F401  (they register their queries)
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
