"""Text splitting and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: word separators (space, tab, newline, carriage return, form feed).
WORD_SEPARATORS = r"[ \t\n\r\f]+"


def word_count(df: DataFrame, text_col: str = "text", pattern: str = WORD_SEPARATORS,
               word_col: str = "word", count_col: str = "n") -> DataFrame:
    """Count words over whole texts: split on ``pattern``, keep case, drop
    empty tokens. Counting aggregates partially per map task, so frequent
    words are pre-summed before the shuffle."""
    words = df.select(F.explode(F.split(F.col(text_col), pattern)).alias(word_col))
    return (words.filter(F.col(word_col) != "")
            .groupBy(word_col).agg(F.count(F.lit(1)).alias(count_col)))


def split_explode(df: DataFrame, column: str, sep: str = ",", keep: tuple = (),
                  item_col: str = "item", pos_col: str = "pos") -> DataFrame:
    """One row per list item of a separated text (items are NOT trimmed);
    ``pos`` is 0-based."""
    import re
    return df.select(*keep, F.posexplode(F.split(F.col(column), re.escape(sep)))
                     .alias(pos_col, item_col))
