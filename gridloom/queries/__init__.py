"""Queries over the test tables, each with the same result in SQL."""

from gridloom.queries import data, elementwise, layers, linear, training, words
from gridloom.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data", "elementwise", "layers", "linear", "training", "words"]
