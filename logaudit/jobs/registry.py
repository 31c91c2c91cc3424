"""All queries of the library by name, and the SQL that each must match."""

from __future__ import annotations

from logaudit.jobs import log_queries, signal_queries

QUERIES: dict = log_queries.Q | signal_queries.Q
ORACLE_SQL: dict = log_queries.S | signal_queries.S
