"""All queries for the driver, and their equivalents in SQL."""

from __future__ import annotations

from spindrift.plans import agent, index, logs, lookups, retrieval, scalars, search, symbols  # noqa: F401
from spindrift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
