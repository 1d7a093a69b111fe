"""Registered queries and their DuckDB forms."""

from __future__ import annotations

from . import newsroom  # noqa: F401  registers its queries
from .comps import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
