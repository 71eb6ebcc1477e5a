"""Registered queries over the driver's tables."""

from quarry.plans import archives, foreign, scalars
from quarry.plans.archives import flagship

QUERIES = scalars.QUERIES | archives.QUERIES | foreign.QUERIES
ORACLE_SQL = scalars.ORACLE_SQL | archives.ORACLE_SQL | foreign.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
