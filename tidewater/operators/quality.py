"""Validation with quarantine, and time-based retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event kinds accepted by validation.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

# Reject reasons, in the order the rules are checked.
REJECT_REASONS = ("missing_key", "missing_ts", "unknown_type", "bad_value", "bad_props")


def reject_reason(key: str = "event_id", ts: str = "ts", kind: str = "event_type",
                  value: str = "value", props: str = "props",
                  allowed: Sequence[str] = EVENT_TYPES) -> Column:
    """The first broken rule, or NULL for a valid row: key and time present,
    known kind, value present, a number and >= 0, props parses as JSON."""
    return (F.when(F.col(key).isNull(), F.lit("missing_key"))
            .when(F.col(ts).isNull(), F.lit("missing_ts"))
            .when(F.col(kind).isNull() | ~F.col(kind).isin(list(allowed)), F.lit("unknown_type"))
            .when(F.col(value).isNull() | F.isnan(F.col(value).cast("double")) | (F.col(value) < 0),
                  F.lit("bad_value"))
            .when(F.try_parse_json(F.col(props)).isNull(), F.lit("bad_props")))


def tag_rejects(df: DataFrame, **kw) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(**kw))


def validated(df: DataFrame, **kw) -> DataFrame:
    """Rows that pass every rule (schema unchanged)."""
    return tag_rejects(df, **kw).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(df: DataFrame, **kw) -> DataFrame:
    """Rows that fail, with the first failing rule in ``reject_reason``."""
    return tag_rejects(df, **kw).filter(F.col("reject_reason").isNotNull())


def write_validated(df: DataFrame, out_path: str, mode: str = "append", **kw) -> None:
    """Write valid and quarantined rows in ONE pass over the input: one table
    partitioned by ``status`` (``valid`` / ``quarantine``)."""
    tagged = tag_rejects(df, **kw).withColumn(
        "status", F.when(F.col("reject_reason").isNull(), F.lit("valid"))
                   .otherwise(F.lit("quarantine")))
    tagged.write.mode(mode).partitionBy("status").parquet(out_path)


def retention_filter(df: DataFrame, ts: str = "ts", days: int = 7) -> DataFrame:
    """Rows not older than ``days`` before the newest timestamp. The newest
    timestamp is a scalar subquery (one small aggregate job), not a join."""
    newest = df.select(F.max(F.col(ts))).scalar()
    return df.filter(F.col(ts) >= newest - F.make_dt_interval(days=F.lit(days)))
