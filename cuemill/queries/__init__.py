"""Registered queries of the operators and their DuckDB counterparts."""

from __future__ import annotations

from . import joins, scalars, shaping, streams
from ._registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "joins", "scalars", "shaping", "streams"]
