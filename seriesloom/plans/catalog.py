"""All registered queries of the series operators."""

from . import band_queries, closing_queries, court_queries, further_queries, more_queries, run_queries, stage_queries, table_queries  # noqa: F401
from . import extension_queries  # noqa: F401  (takes the SQL of others)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
