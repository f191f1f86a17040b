"""Queries on the driver's tables and their DuckDB SQL."""

from quaestor.plans import aggregates, changes, indexes, joins, ordered, scalars  # noqa: F401  they register their queries
from quaestor.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
