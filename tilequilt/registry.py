"""All registered queries of the raster engine, with their oracle SQL."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
