"""Row filters with parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_eq(df: DataFrame, column: str, value=None, default=None) -> DataFrame:
    """Rows where ``column == value``; ``default`` is used when no value is
    given (for example the configured namespace)."""
    v = value if value not in (None, "") else default
    return df.filter(F.col(column) == F.lit(v))


def filter_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def filter_not_contains(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column does not contain ``text`` (like ``grep -v``)."""
    return df.filter(~F.contains(F.col(column), F.lit(text)))
