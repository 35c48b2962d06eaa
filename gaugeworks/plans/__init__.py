"""Queries over the driver's tables, with SQL that another engine can run for comparison."""

from . import planning, runs, scoring  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
