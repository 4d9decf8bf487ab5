"""Named queries over the driver's tables, composed of the operators."""

from . import blocks, features, planning, production, reports, style, tables, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "blocks", "features", "planning", "production", "reports", "style", "tables", "text"]
