"""All queries of the canonical tables and their SQL."""

from __future__ import annotations

from quarry.plans import files, golden, histories, lists, pages, publications, reports, tables, texts  # noqa: F401  they register their queries
from quarry.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
