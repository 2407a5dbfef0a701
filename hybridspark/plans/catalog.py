"""All registered queries."""

from __future__ import annotations

from . import documents, entities, listings, retrieval, values  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES
from .retrieval import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
