"""All queries of the engine and, where SQL can state them, their oracles."""

from pagelathe.plans import mined, oracles, queries

QUERIES = queries.QUERIES | mined.QUERIES
ORACLES = oracles.ORACLES | mined.ORACLES

__all__ = ["ORACLES", "QUERIES"]
