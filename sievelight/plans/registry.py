"""Queries and oracle SQL of the core operators, keyed by operator id."""

from . import analysis, findings, platform  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
