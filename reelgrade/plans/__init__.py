"""Registered queries and their DuckDB counterparts."""

from . import programs  # noqa: F401  registers its queries
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
