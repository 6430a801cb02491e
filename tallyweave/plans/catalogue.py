"""All registered queries and their SQL."""

from tallyweave.plans import intervals, profiling, queries, served, stored, vectors  # noqa: F401  (they register themselves)
from tallyweave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
