"""Queries of the operators over the driver's tables, each with its SQL where SQL can express it."""

from . import changes, graphs, logs, rollups, rulebook, shapes, sources, surface, texts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
