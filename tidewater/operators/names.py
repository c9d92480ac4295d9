"""Names for helper columns that no input column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused_name(base: str, *frames: DataFrame) -> str:
    """``base``, with underscores put before it until no frame has a column of
    that name (names are compared without case, as Spark does)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def unused_names(bases: str, *frames: DataFrame) -> list[str]:
    """``unused_name`` of each of the space-separated ``bases``."""
    return [unused_name(b, *frames) for b in bases.split()]
