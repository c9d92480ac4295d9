"""Timestamps as display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def display_ts(ts, pattern: str = "dd MMM, HH:mm") -> Column:
    """Short day-month-time text (en-GB style), a dash when NULL. The session
    time zone decides the wall clock."""
    return F.coalesce(F.date_format(_col(ts), pattern), F.lit(DASH))


def iso_ts(ts, with_offset: bool = False) -> Column:
    """ISO-8601 text like Python's ``isoformat()``: microseconds only when
    non-zero; ``+00:00``-style offset for zone-aware timestamps. NULL stays
    NULL."""
    t = _col(ts)
    frac = F.date_format(t, "SSSSSS")
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))
    if with_offset:
        text = F.concat(text, F.date_format(t, "xxx"))
    return text
