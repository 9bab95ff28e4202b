"""The library's queries and the SQL that their results must equal."""

from __future__ import annotations

from quarrymill.plans import mixed_queries, records_queries  # noqa: F401  they register their queries
from quarrymill.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
