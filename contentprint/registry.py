"""All queries outside the text-preparation subpackage, by name."""

from __future__ import annotations

from .plans.queries import ORACLE_SQL, QUERIES
__all__ = ["ORACLE_SQL", "QUERIES"]
