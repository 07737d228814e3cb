"""The registered queries: what each runs on Spark, and the same thing in SQL."""

from catalog import cases, contexts, files, operators, raw, reports, skew, views
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cases", "contexts", "files", "operators", "raw", "reports", "skew", "views"]
