"""Registered queries with the SQL to compare them with."""

from . import tables  # noqa: F401  isort: skip
from . import applying, envelopes, monitoring, operations, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
