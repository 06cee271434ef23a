"""The registered queries."""

from . import extract_queries, index_queries, number_queries, point_queries, record_queries, report_queries, sketch_queries, stated_queries, stream_queries, text_queries  # noqa: F401
from . import checked_queries  # noqa: F401  (builds on the SQL of the others)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
