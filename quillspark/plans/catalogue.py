"""All queries by key, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import evaluate, relations, rules, texts, timeseries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluate", "relations", "rules", "texts", "timeseries"]
