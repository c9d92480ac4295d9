"""Stateful streams in append mode: what they write is final, and their state
shrinks as the watermark passes.

Event time drives all of them. ``delay`` is how far an event may be behind the
newest one seen; state is kept that long. Rows that come later are dropped by
Spark before they reach the state and counted in the query's progress
(``stream_counts``), and what a bronze table holds of them is found again by
``missed_rows``. State is partitioned by key over ``spark.sql.shuffle.partitions``
stores and restored from the checkpoint folder after a restart; for state that
does not fit executor memory set the RocksDB provider (``ROCKSDB``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from tidewater.operators.names import unused_name
from tidewater.streaming.jobs import _trigger

#: Session settings for state on executor disk with changelog checkpoints.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


#: Names of the session zone in which a time without a zone is itself.
_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00", "Zulu", "Etc/GMT")


def _event_time(stream: DataFrame, ts: str, delay: str, *others: DataFrame) -> tuple[DataFrame, str]:
    """The stream with a watermark on a further column, and that column's
    name: ``ts`` as an instant. Times without a zone are taken as UTC, which
    the session zone has to be for them (``get_spark`` sets it)."""
    if isinstance(stream.schema[ts].dataType, TimestampNTZType):
        zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
        if zone not in _UTC:
            raise ValueError(f"{ts} has no zone: set spark.sql.session.timeZone to UTC, not {zone}")
    name = unused_name("_event_time", stream, *others)
    return stream.withColumn(name, F.col(ts).cast("timestamp")).withWatermark(name, delay), name


def append_stream(stream: DataFrame, path: str, checkpoint: str, trigger: str | None = None,
                  partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append a stream to a parquet folder; the folder's commit log and the
    checkpoint make each micro-batch appear once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, trigger).start(path)


def first_deliveries(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The stream without repeated deliveries: of rows with equal ``keys``
    the first one stays, and later ones go as long as its key is in the state
    (until the watermark passes its time by ``delay``).

    Rows with a NULL in ``keys`` are repeats of each other only where all
    columns are equal. Rows without a time can't be kept in the state: they
    pass, less repeats within their micro-batch."""
    whole = unused_name("_whole", stream)
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    marked = stream.withColumn(whole, F.when(keyless, F.sha2(F.to_json(F.struct(*stream.columns)), 256)))
    timed, at = _event_time(marked, ts, delay)
    return timed.dropDuplicatesWithinWatermark([*keys, whole]).drop(whole, at)


def window_totals(stream: DataFrame, ts: str, delay: str, aggs: Mapping[str, Column], size: str,
                  slide: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """window_start, window_end, keys and aggregates of every tumbling (or,
    with ``slide``, sliding) window, each written once, when the watermark
    passes its end. Rows without a time are in no window."""
    timed, at = _event_time(stream, ts, delay)
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return _totals(stream, timed, window, "window", ts, keys, aggs)


def session_totals(stream: DataFrame, ts: str, delay: str, aggs: Mapping[str, Column], gap: str,
                   keys: Sequence[str] = ()) -> DataFrame:
    """session_start, session_end, keys and aggregates of every session: a
    key's events less than ``gap`` apart, ended ``gap`` after the last one.
    A late event within the watermark merges the sessions it connects."""
    timed, at = _event_time(stream, ts, delay)
    return _totals(stream, timed, F.session_window(at, gap), "session", ts, keys, aggs)


def _totals(stream: DataFrame, timed: DataFrame, window: Column, kind: str, ts: str, keys: Sequence[str],
            aggs: Mapping[str, Column]) -> DataFrame:
    """Aggregates per window and keys; its bounds have the type of ``ts``."""
    name = unused_name("_window", timed)
    grouped = timed.groupBy(window.alias(name), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    bounds = [F.col(f"{name}.{x}").cast(stream.schema[ts].dataType).alias(f"{kind}_{x}") for x in ("start", "end")]
    return grouped.select(*bounds, *keys, *aggs)


def silent_keys(stream: DataFrame, key: str, ts: str, quiet: str, delay: str) -> DataFrame:
    """key, first_seen, last_seen, silent_at, n_events once per silence: when a
    key has had no event for ``quiet`` of event time. The timer is the end of
    the key's session, so a later event of the key starts anew and its next
    silence is reported too. Rows without a key or a time raise no alarm."""
    seen = stream.filter(F.col(key).isNotNull())
    sessions = session_totals(seen, ts, delay, {"n_events": F.count(F.lit(1)), "last_seen": F.max(ts)}, quiet, [key])
    return sessions.select(key, F.col("session_start").alias("first_seen"), "last_seen",
                           F.col("session_end").alias("silent_at"), "n_events")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_ts: str, right_ts: str,
                  earliest: str, latest: str, left_delay: str, right_delay: str) -> DataFrame:
    """Pairs of rows of two streams with equal ``keys`` (left, right column)
    where the right time is between left time + ``earliest`` and left time +
    ``latest``, both inclusive. Column names must differ between the sides.

    Each side keeps a row only as long as the other side's watermark allows a
    partner to come; rows with a NULL key or time have none."""
    shared = set(left.columns) & set(right.columns)
    if shared:
        raise ValueError(f"both streams have columns {sorted(shared)}: rename them first")
    first, at = _event_time(left, left_ts, left_delay, right)
    second, then = _event_time(right, right_ts, right_delay, first)
    near = (F.col(then) >= F.col(at) + F.expr(f"INTERVAL {earliest}")) & (F.col(then) <= F.col(at) + F.expr(f"INTERVAL {latest}"))
    for a, b in keys:
        near = near & (F.col(a) == F.col(b))
    return first.join(second, near, "inner").drop(at, then)


def stream_counts(query: StreamingQuery) -> dict[str, int]:
    """Totals over a query's recent progress (as many micro-batches as
    ``spark.sql.streaming.numRecentProgressUpdates`` keeps): input rows, rows
    dropped as too late, repeats dropped, and the rows in the state after the
    last batch. Aggregates count late rows after partial aggregation, per
    group."""
    batches = query.recentProgress
    state = [op for b in batches for op in b.stateOperators]
    return {"rows": sum(b.numInputRows for b in batches),
            "late": sum(op.numRowsDroppedByWatermark for op in state),
            "repeats": sum(int(op.customMetrics.get("numDroppedDuplicateRows", 0)) for op in state),
            "state_rows": sum(op.numRowsTotal for op in batches[-1].stateOperators) if batches else 0}


def missed_rows(bronze: DataFrame, written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the raw table whose keys never reached the stream's output:
    what came too late, to be added by a batch run. NULL keys match nothing
    and are not reported."""
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    return bronze.filter(usable).join(written.select(*keys).distinct(), list(keys), "left_anti")
