"""Registered queries; importing this package registers them all."""

from . import browse, changes, measures, retrieval, scalars
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "browse", "changes", "measures", "retrieval", "scalars"]
