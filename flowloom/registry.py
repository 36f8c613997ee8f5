"""The queries of the routing engine and their SQL for DuckDB."""

from __future__ import annotations

from .plans import fleet, more, reports  # noqa: F401  register their queries
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
