"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from . import interval_queries, relational_queries, source_queries, statistics_queries

QUERIES = interval_queries.QUERIES | relational_queries.QUERIES | statistics_queries.QUERIES | source_queries.QUERIES
ORACLE = interval_queries.ORACLE | relational_queries.ORACLE | statistics_queries.ORACLE | source_queries.ORACLE
