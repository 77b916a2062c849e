"""Registered queries."""

from factloom.plans import composed, graphs, search, temporal, upkeep, world
from factloom.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "composed", "graphs", "search", "temporal", "upkeep", "world"]
