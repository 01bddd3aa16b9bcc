"""Queries over the driver's tables, with the SQL that gives the same rows."""

from . import files, textual, trajectory, vectorial
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "textual", "trajectory", "vectorial"]
