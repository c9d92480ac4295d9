"""Queries over time and order within keys: as-of join, exact quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.slices import asof_join, quantiles_by_key
from tidewater.plans.registry import query
from tidewater.sources.files import read_table


@query("asof_join", """
SELECT p.event_id, p.user_id, p.ts, c.seen_id, c.seen_ts
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id AS seen_id, user_id, ts AS seen_ts FROM events WHERE event_type = 'view') c
  ON p.user_id = c.user_id AND p.ts >= c.seen_ts
""")
def q_asof_join(spark: SparkSession, d: str) -> DataFrame:
    """The last view of the same user before (or at) each purchase."""
    ev = read_table(spark, d, "events")
    bought = ev.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    seen = ev.filter(F.col("event_type") == "view").select(F.col("event_id").alias("seen_id"), "user_id", F.col("ts").alias("seen_ts"))
    return asof_join(bought, seen, "user_id", "ts", "seen_ts")


@query("asof_join_hot", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id,
                  CASE WHEN event_id % 50 <> 7 THEN ts END AS ts, event_type FROM events),
p AS (SELECT event_id, user_id, ts FROM e WHERE event_type <> 'view')
SELECT p.event_id, p.user_id, p.ts, c.seen_id, c.seen_ts
FROM p ASOF JOIN (SELECT event_id AS seen_id, user_id, ts AS seen_ts FROM e WHERE event_type = 'view') c
  ON p.user_id = c.user_id AND p.ts >= c.seen_ts
""")
def q_asof_join_hot(spark: SparkSession, d: str) -> DataFrame:
    """The same for all other events where one user has a third of the rows
    and some rows have no time, without the rows that have no partner."""
    ev = read_table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 50 != 7, F.col("ts")).alias("ts"), "event_type")
    other = ev.filter(F.col("event_type") != "view").select("event_id", "user_id", "ts")
    seen = ev.filter(F.col("event_type") == "view").select(F.col("event_id").alias("seen_id"), "user_id", F.col("ts").alias("seen_ts"))
    return asof_join(other, seen, "user_id", "ts", "seen_ts", how="inner")


QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


@query("quantiles_by_key", "\nUNION ALL\n".join(f"""
SELECT l_returnflag, {q!r}::DOUBLE AS q, quantile_disc(l_extendedprice, {q!r}) AS price FROM lineitem GROUP BY l_returnflag
""".strip() for q in QUANTILES))
def q_quantiles_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Exact price quantiles per return flag: three keys, each with a quarter
    of all rows or more."""
    return quantiles_by_key(read_table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", QUANTILES, value_col="price")
