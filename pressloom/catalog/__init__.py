"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from .base import ORACLES, QUERIES
from . import cleaning, counting, records, similarity, sentiment, text, topics, upserts  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
