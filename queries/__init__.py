"""Checked queries over the driver tables."""

from queries.registry import ORACLES, QUERIES
from queries import scalars, relations, files  # noqa: F401  (they register their queries)

__all__ = ["ORACLES", "QUERIES"]
