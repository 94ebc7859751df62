"""The catalogue of queries and the SQL they are held against."""

from assaygrid.plans import intake, panels, rounds, search, served, stored, streams, tabular  # noqa: F401  registers their queries
from assaygrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
