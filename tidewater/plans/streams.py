"""Streaming queries. Each runs to completion with ``availableNow`` into the
shared folder (sink + checkpoint), and the query returns a batch read of the
sink, so nothing is left running and nothing is gathered on the driver."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.batch import _TAGGED_EVENTS_SQL
from tidewater.plans.registry import query
from tidewater.session import shared_dir
from tidewater.sources.events import EVENTS_SCHEMA, EventSourceSpec, event_source
from tidewater.sources.files import read_table
from tidewater.streaming.decode import decode_events
from tidewater.streaming.jobs import (bronze_ingest, compact_running, read_running_result, read_running_updates,
                                      running_aggregate, running_updates, validate_stream)
from tidewater.streaming.stateful import (append_stream, first_deliveries, interval_join, session_totals, silent_keys,
                                          window_totals)


def _event_files(spark: SparkSession, d: str, max_files: int | None = None) -> DataFrame:
    spec = EventSourceSpec(kind="files", path=f"{d.rstrip('/')}/events*.parquet",
                           max_per_trigger=max_files)
    return event_source(spark, spec, EVENTS_SCHEMA)


@query("stream_bronze", "SELECT * FROM events")
def q_stream_bronze(spark: SparkSession, d: str) -> DataFrame:
    root = shared_dir(spark, "bronze")
    q = bronze_ingest(_event_files(spark, d), f"{root}/table", f"{root}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/table").drop("ingest_ts")


@query("stream_running_agg", """
SELECT event_type, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM events GROUP BY event_type
""")
def q_stream_running_agg(spark: SparkSession, d: str) -> DataFrame:
    root = shared_dir(spark, "running")
    q = running_aggregate(_event_files(spark, d), ["event_type"],
                          {"n": F.count(F.lit(1)), "total_value": F.sum(F.col("value").cast("decimal(18,2)"))},
                          f"{root}/result", f"{root}/_checkpoint")
    q.awaitTermination()
    out = read_running_result(spark, f"{root}/result")
    return out.select("event_type", "n", F.col("total_value").cast("double").alias("total_value"))


@query("stream_validate", _TAGGED_EVENTS_SQL + """
SELECT *, CASE WHEN reject_reason IS NULL THEN 'valid' ELSE 'quarantine' END AS status FROM t
""")
def q_stream_validate(spark: SparkSession, d: str) -> DataFrame:
    """Validation as a stream over derived events (every 17th value made
    negative): valid and quarantined rows land in one folder partitioned by
    status, in one pass."""
    root = shared_dir(spark, "validated")
    ev = read_table(spark, d, "events")
    ev.withColumn("value", F.when(F.col("event_id") % 17 == 0, -F.col("value"))
                  .otherwise(F.col("value"))).write.parquet(f"{root}/in")
    stream = event_source(spark, EventSourceSpec(kind="files", path=f"{root}/in"))
    q = validate_stream(stream, f"{root}/out", f"{root}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        "event_id", "ts", "user_id", "event_type", "value", "props", "reject_reason", "status")


@query("stream_decode", """
WITH e AS (
  SELECT event_id, user_id, event_type, event_id % 11 = 0 AS broken,
         CASE WHEN event_id % 7 = 0 THEN date_trunc('second', ts) ELSE ts END AS ts,
         CASE WHEN event_id % 7 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS shown
  FROM events),
p AS (
  SELECT *, CASE WHEN broken THEN 'x' ELSE '' END || '{"event_id":' || event_id || ',"ts":"' || shown
         || '","user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS raw FROM e)
SELECT CASE WHEN NOT broken THEN event_id END AS event_id, CASE WHEN NOT broken THEN ts END AS ts,
       CASE WHEN NOT broken THEN user_id END AS user_id,
       CASE WHEN NOT broken THEN event_type END AS event_type, raw
FROM p
""")
def q_stream_decode(spark: SparkSession, d: str) -> DataFrame:
    """Topic payloads replayed from files: JSON lines streamed as text, decoded
    with the explicit schema and appended to a bronze folder with their raw
    text. Every 11th line is no JSON, every 7th time has no fraction."""
    root = shared_dir(spark, "payloads")
    i = F.col("event_id")
    shown = (F.when(i % 7 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
             .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    payload = F.concat(F.when(i % 11 == 0, "x").otherwise(""), F.lit('{"event_id":'), i.cast("string"),
                       F.lit(',"ts":"'), shown, F.lit('","user_id":'), F.col("user_id").cast("string"),
                       F.lit(',"event_type":"'), F.col("event_type"), F.lit('"}'))
    read_table(spark, d, "events").select(payload.alias("value")).write.text(f"{root}/in")
    raw = event_source(spark, EventSourceSpec(kind="files", path=f"{root}/in",
                                              file_format="text"))
    q = bronze_ingest(decode_events(raw, keep_raw=True), f"{root}/table", f"{root}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/table").select("event_id", "ts", "user_id", "event_type", "raw")


# ------------------------------------------------- state bounded by a watermark

def _time_range(ev: DataFrame) -> tuple:
    """First and last event time (one row of an aggregate)."""
    return tuple(ev.agg(F.min("ts"), F.max("ts")).first())


def _replay(spark: SparkSession, d: str, name: str, deliveries, build) -> DataFrame:
    """Write each delivery to a folder and run the stream over the folder to
    its end, from the same checkpoint each time: every delivery is a restart.
    ``build`` makes the stream's result from a fresh read of the folder."""
    root = shared_dir(spark, name)
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{root}/in")
        stream = event_source(spark, EventSourceSpec(kind="files", path=f"{root}/in"))
        append_stream(build(stream), f"{root}/out", f"{root}/_checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _two_halves(spark: SparkSession, d: str) -> list[DataFrame]:
    """The events in two deliveries by time, with a last row ten days on,
    without a type and a user, that moves the watermark past all others."""
    ev = read_table(spark, d, "events")
    first, last = _time_range(ev)
    middle = first + (last - first) / 2
    end = ev.limit(1).select("event_id", F.lit(last + timedelta(days=10)).alias("ts"), F.lit(None).cast("bigint").alias("user_id"),
                             F.lit(None).cast("string").alias("event_type"), "value", "props")
    return [ev.filter(F.col("ts") < F.lit(middle)), ev.filter(F.col("ts") >= F.lit(middle)).unionByName(end)]


@query("stream_dedup", "SELECT DISTINCT * FROM events")
def q_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events delivered in thirds of their time, some twice in one delivery or
    again in the next one (after a restart), and some of the second third held
    back until the third: each is written once."""
    ev = read_table(spark, d, "events")
    first, last = _time_range(ev)
    third = (last - first) / 3
    part = [F.col("ts") < F.lit(first + third), (F.col("ts") >= F.lit(first + third)) & (F.col("ts") < F.lit(first + 2 * third)),
            F.col("ts") >= F.lit(first + 2 * third)]
    i = F.col("event_id")
    one, two, three = [ev.filter(p) for p in part]
    late = i % 7 == 0
    deliveries = [one.unionByName(one.filter(i % 5 == 0)),
                  two.filter(~late).unionByName(one.filter(i % 11 == 0)).unionByName(two.filter(~late & (i % 2 == 0))),
                  three.unionByName(two.filter(late)).unionByName(two.filter(i % 3 == 0)).unionByName(one.filter(i % 13 == 0))]
    delay = f"{int(third.total_seconds()) + 60} seconds"
    return _replay(spark, d, "dedup", deliveries, lambda s: first_deliveries(s, ["event_id"], "ts", delay))


def _totals() -> dict:
    return {"n": F.count(F.lit(1)), "total_value": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")}


@query("stream_windows", """
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
       event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM events GROUP BY ALL
""")
def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Totals per type and six hours, each window written once it is closed."""
    return _replay(spark, d, "windows", _two_halves(spark, d),
                   lambda s: window_totals(s, "ts", "1 hour", _totals(), "6 hours", keys=["event_type"]))


@query("stream_sliding", """
WITH w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS window_start
           FROM events, (SELECT unnest([0, 1, 2]) AS k))
SELECT window_start, window_start + INTERVAL 3 HOUR AS window_end, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM w GROUP BY ALL
""")
def q_stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the three hours before every full hour."""
    return _replay(spark, d, "sliding", _two_halves(spark, d),
                   lambda s: window_totals(s, "ts", "1 hour", _totals(), "3 hours", "1 hour"))


_SESSIONS_SQL = """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
"""


@query("stream_sessions", _SESSIONS_SQL + """
SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM s GROUP BY user_id, k
""")
def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Totals per user and session of events less than two hours apart."""
    return _replay(spark, d, "sessions", _two_halves(spark, d),
                   lambda s: session_totals(s.filter(F.col("user_id").isNotNull() | F.col("event_type").isNull()),
                                            "ts", "1 hour", _totals(), "2 hours", ["user_id"]))


@query("stream_silent_keys", _SESSIONS_SQL + """
SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) + INTERVAL 2 HOUR AS silent_at, count(*) AS n_events
FROM s GROUP BY user_id, k
""")
def q_stream_silent_keys(spark: SparkSession, d: str) -> DataFrame:
    """Users without an event for two hours, once per silence. The row that
    ends the replay has a user of its own here, whose silence never comes."""
    ended = [x.withColumn("user_id", F.coalesce("user_id", F.lit(-1).cast("bigint"))) for x in _two_halves(spark, d)]
    return _replay(spark, d, "silent", ended, lambda s: silent_keys(s, "user_id", "ts", "2 hours", "1 hour"))


@query("stream_interval_join", """
SELECT a.event_id AS error_id, b.event_id, a.user_id, b.ts
FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3 HOUR
WHERE a.event_type = 'error' AND b.event_type = 'purchase'
""")
def q_stream_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of a user in the three hours after each of their errors, as
    a join of two streams."""
    def pairs(stream: DataFrame) -> DataFrame:
        errors = stream.filter(F.col("event_type") == "error").select(
            F.col("event_id").alias("error_id"), F.col("user_id"), F.col("ts").alias("error_ts"))
        bought = stream.filter(F.col("event_type") == "purchase").select("event_id", F.col("user_id").alias("buyer"), "ts")
        return (interval_join(errors, bought, [("user_id", "buyer")], "error_ts", "ts", "0 seconds", "3 hours", "1 hour", "1 hour")
                .select("error_id", "event_id", "user_id", "ts"))
    return _replay(spark, d, "pairs", _two_halves(spark, d), pairs)


@query("stream_running_updates", """
SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM events GROUP BY user_id
""")
def q_stream_running_updates(spark: SparkSession, d: str) -> DataFrame:
    """Running totals per user over two deliveries, of which only changed
    users are written, folded into one epoch after the second."""
    root = shared_dir(spark, "updates")
    ev = read_table(spark, d, "events")
    for rows in (ev.filter("event_id % 3 > 0"), ev.filter("event_id % 3 = 0")):
        rows.write.mode("append").parquet(f"{root}/in")
        stream = event_source(spark, EventSourceSpec(kind="files", path=f"{root}/in"))
        running_updates(stream, ["user_id"], {"n": F.count(F.lit(1)), "total_value": F.sum(F.col("value").cast("decimal(18,2)"))},
                        f"{root}/out", f"{root}/_checkpoint").awaitTermination()
    compact_running(spark, f"{root}/out", f"{root}/_checkpoint", ["user_id"])
    out = read_running_updates(spark, f"{root}/out", f"{root}/_checkpoint", ["user_id"])
    return out.select("user_id", "n", F.col("total_value").cast("double").alias("total_value"))


@query("stream_restart", "SELECT * FROM events")
def q_stream_restart(spark: SparkSession, d: str) -> DataFrame:
    """Bronze ingest of three deliveries, stopped and started again after each
    and once more with nothing new: every event is written once."""
    root = shared_dir(spark, "restart")
    ev = read_table(spark, d, "events")
    for rows in (*[ev.filter(F.pmod(F.col("event_id"), F.lit(3)) == k) for k in range(3)], None):
        if rows is not None:
            rows.write.mode("append").parquet(f"{root}/in")
        stream = event_source(spark, EventSourceSpec(kind="files", path=f"{root}/in"))
        bronze_ingest(stream, f"{root}/table", f"{root}/_checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table").drop("ingest_ts")


@query("stream_polling", "SELECT * FROM events WHERE event_type = 'error'")
def q_stream_polling(spark: SparkSession, d: str) -> DataFrame:
    """A query that stays up and polls its folder by a processing-time trigger:
    files that come while it runs are taken, then it is stopped."""
    root = shared_dir(spark, "polling")
    errors = read_table(spark, d, "events").filter("event_type = 'error'")
    errors.filter("event_id % 2 = 0").write.mode("append").parquet(f"{root}/in")
    stream = event_source(spark, EventSourceSpec(kind="files", path=f"{root}/in"))
    q = bronze_ingest(stream, f"{root}/table", f"{root}/_checkpoint", trigger="200 milliseconds")
    try:
        q.processAllAvailable()
        errors.filter("event_id % 2 <> 0").write.mode("append").parquet(f"{root}/in")
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{root}/table").drop("ingest_ts")
