"""Named queries over the given tables, each with its DuckDB oracle SQL."""

from tidewater.plans.registry import ORACLE, QUERIES

# Importing the modules registers their queries.
from tidewater.plans import batch, shapes, streams, tables, temporal  # noqa: F401,E402

__all__ = ["QUERIES", "ORACLE"]
