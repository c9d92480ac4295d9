"""Streams whose state is bounded by a watermark: repeats, windows, sessions,
joins; restarts, late rows and the size of the state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.session import shared_dir
from tidewater.streaming import (ROCKSDB, append_stream, first_deliveries, interval_join, missed_rows, session_totals,
                                 silent_keys, stream_counts, window_totals)

T0 = dt.datetime(2024, 5, 1)
SCHEMA = "id long, ts timestamp_ntz, user string, v int"


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


class Feed:
    """A folder of deliveries and a stream over it that is stopped after each."""

    def __init__(self, spark, build, schema=SCHEMA):
        self.spark, self.build, self.schema = spark, build, schema
        self.root = shared_dir(spark, "test-feed")

    def deliver(self, *rows):
        df = self.spark.createDataFrame([(i, at(m), *rest) for i, m, *rest in rows], self.schema)
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        return self.run()

    def run(self):
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.root}/in")
        q = append_stream(self.build(stream), f"{self.root}/out", f"{self.root}/_checkpoint")
        q.awaitTermination()
        return stream_counts(q)

    def bronze(self):
        return self.spark.read.parquet(f"{self.root}/in")

    def out(self):
        return self.spark.read.parquet(f"{self.root}/out")


def dedup(stream):
    return first_deliveries(stream, ["id"], "ts", "30 minutes")


def test_repeats_across_restarts_and_late_rows(spark):
    feed = Feed(spark, dedup)
    assert feed.deliver((1, 0, "a", 1), (2, 5, "a", 1), (1, 0, "a", 1))["repeats"] == 1
    # again after a restart, and a late row within the delay
    counts = feed.deliver((2, 5, "a", 1), (3, 40, "b", 1), (4, 2, "c", 1), (4, 2, "c", 1))
    assert (counts["repeats"], counts["late"]) == (2, 0)
    assert sorted(r.id for r in feed.out().collect()) == [1, 2, 3, 4]
    feed.deliver((5, 200, "b", 1))
    # the watermark is at 170 now: too late is dropped, but counted
    counts = feed.deliver((6, 100, "b", 1), (5, 200, "b", 1), (7, 171, "b", 1))
    assert (counts["rows"], counts["late"], counts["repeats"]) == (3, 1, 1)
    assert sorted(r.id for r in feed.out().collect()) == [1, 2, 3, 4, 5, 7]
    assert [r.id for r in missed_rows(feed.bronze(), feed.out(), ["id"]).collect()] == [6]
    # nothing new, nothing written
    assert feed.run()["rows"] == 0 and feed.out().count() == 6


def test_dedup_state_is_evicted(spark):
    feed = Feed(spark, dedup)
    assert feed.deliver(*[(i, i % 20, "a", 1) for i in range(500)])["state_rows"] == 500
    assert feed.deliver((1000, 1000, "a", 1))["state_rows"] <= 1


def test_dedup_without_key_or_time(spark):
    feed = Feed(spark, lambda s: first_deliveries(s.withColumn("_whole", F.lit(7)), ["id"], "ts", "30 minutes"))
    feed.deliver((None, 0, "a", 1), (None, 0, "a", 1), (None, 0, "a", 2), (1, None, "a", 1), (2, None, "a", 1))
    feed.deliver((None, 0, "a", 1), (3, 10, "a", 1))
    rows = sorted(((r.id or 0, r.v) for r in feed.out().collect()))
    assert rows == [(0, 1), (0, 2), (1, 1), (2, 1), (3, 1)]
    assert {r._whole for r in feed.out().collect()} == {7}


@pytest.fixture
def rocksdb(spark):
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_state_in_rocksdb(spark, rocksdb):
    feed = Feed(spark, dedup)
    feed.deliver((1, 0, "a", 1), (2, 5, "a", 1))
    assert feed.deliver((2, 5, "a", 1), (3, 6, "a", 1))["repeats"] == 1
    assert sorted(r.id for r in feed.out().collect()) == [1, 2, 3]
    feed = Feed(spark, lambda s: silent_keys(s, "user", "ts", "20 minutes", "5 minutes"))
    feed.deliver((1, 0, "a", 1), (2, 10, "b", 1))
    feed.deliver((3, 5, "a", 1), (4, 100, "c", 1))
    assert sorted((r.user, r.silent_at) for r in feed.out().collect()) == [("a", at(25)), ("b", at(30))]
    feed = Feed(spark, pairs)
    feed.deliver((1, 0, "a", 1))
    feed.deliver((2, 20, "a", 2))
    assert [(r.l, r.r) for r in feed.out().collect()] == [(1, 2)]


def totals():
    return {"n": F.count(F.lit(1)), "total": F.sum("v")}


def test_tumbling_windows_are_written_once_closed(spark):
    feed = Feed(spark, lambda s: window_totals(s, "ts", "10 minutes", totals(), "60 minutes", keys=["user"]))
    feed.deliver((1, 5, "a", 1), (2, 59, "a", 2), (3, 60, "a", 4), (4, None, "a", 8))
    assert feed.out().count() == 0
    feed.deliver((5, 58, "b", 16), (6, 100, "a", 32))       # 58 is late but in time
    got = {(r.window_start, r.user): (r.n, r.total) for r in feed.out().collect()}
    assert got == {(at(0), "a"): (2, 3), (at(0), "b"): (1, 16)}
    counts = feed.deliver((7, 30, "a", 64), (8, 300, "a", 0))  # too late: its window is closed
    assert counts["late"] == 1
    assert feed.out().filter(F.col("window_start") == F.lit(at(60))).first().total == 36
    assert feed.out().count() == 3


def test_sliding_windows(spark):
    feed = Feed(spark, lambda s: window_totals(s, "ts", "0 minutes", totals(), "30 minutes", "10 minutes"))
    feed.deliver((1, 25, "a", 1), (2, 31, "a", 2))
    feed.deliver((3, 1000, "a", 0))
    got = {(r.window_start - T0).total_seconds() / 60: r.total for r in feed.out().collect()}
    assert got == {0: 1, 10: 3, 20: 3, 30: 2}


def test_a_late_event_merges_sessions(spark):
    feed = Feed(spark, lambda s: session_totals(s, "ts", "60 minutes", totals(), "20 minutes", ["user"]))
    feed.deliver((1, 0, "a", 1), (2, 30, "a", 2), (3, 0, "b", 4))
    feed.deliver((4, 15, "a", 8))
    feed.deliver((5, 500, "c", 0))
    got = {(r.user, r.session_start, r.session_end): (r.n, r.total) for r in feed.out().collect()}
    assert got == {("a", at(0), at(50)): (3, 11), ("b", at(0), at(20)): (1, 4)}


def test_silent_keys_are_told_once(spark):
    feed = Feed(spark, lambda s: silent_keys(s, "user", "ts", "20 minutes", "5 minutes"))
    feed.deliver((1, 0, "a", 1), (2, 10, "a", 1), (3, 0, "b", 1), (4, 0, None, 1), (5, None, "c", 1))
    feed.deliver((6, 33, "b", 1))                      # b was silent from 20 on, a is until 30
    assert [r.user for r in feed.out().collect()] == ["b"]
    feed.deliver((7, 40, "d", 1))
    feed.deliver((8, 41, "d", 1))
    got = sorted((r.user, r.first_seen, r.last_seen, r.silent_at, r.n_events) for r in feed.out().collect())
    assert got == [("a", at(0), at(10), at(30), 2), ("b", at(0), at(0), at(20), 1)]
    feed.deliver((9, 500, "z", 1))
    assert sorted(r.user for r in feed.out().collect()) == ["a", "b", "b", "d"]


def pairs(stream):
    left = stream.filter("v = 1").select(F.col("id").alias("l"), F.col("user").alias("lu"), F.col("ts").alias("lt"))
    right = stream.filter("v = 2").select(F.col("id").alias("r"), F.col("user").alias("ru"), F.col("ts").alias("rt"))
    return interval_join(left, right, [("lu", "ru")], "lt", "rt", "0 minutes", "30 minutes", "10 minutes", "10 minutes")


def test_interval_join_over_restarts(spark):
    feed = Feed(spark, pairs)
    feed.deliver((1, 0, "a", 1), (2, 20, "a", 2), (3, 31, "a", 2), (4, 0, None, 1), (5, 0, None, 2), (6, None, "a", 1))
    feed.deliver((7, 30, "a", 2), (8, 25, "a", 1), (9, 24, "b", 2))    # the partner of 1 comes after a restart
    got = sorted((r.l, r.r) for r in feed.out().collect())
    assert got == [(1, 2), (1, 7), (8, 3), (8, 7)]


def test_interval_join_state_falls(spark):
    feed = Feed(spark, pairs)
    full = feed.deliver(*[(i, i % 10, f"u{i % 5}", 1 + i % 2) for i in range(200)])["state_rows"]
    feed.deliver((1000, 1000, "x", 1), (1001, 1000, "y", 2))
    left = feed.deliver((1002, 1001, "x", 1), (1003, 1001, "y", 2))["state_rows"]
    assert full >= 200 and left <= 8


def test_interval_join_wants_own_names(spark):
    stream = spark.readStream.schema(SCHEMA).parquet(shared_dir(spark, "none") + "/*")
    with pytest.raises(ValueError, match="rename"):
        interval_join(stream, stream, [("user", "user")], "ts", "ts", "0 minutes", "1 minute", "1 minute", "1 minute")


def test_times_without_a_zone_need_utc(spark):
    stream = spark.readStream.schema(SCHEMA).parquet(shared_dir(spark, "none") + "/*")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            dedup(stream)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_running_updates_write_only_what_changed(spark):
    from tidewater.streaming import compact_running, finished_epochs, read_running_updates, running_updates
    root = shared_dir(spark, "test-updates")
    args = (f"{root}/out", f"{root}/_checkpoint")

    def deliver(*rows):
        spark.createDataFrame([(i, at(0), u, v) for i, u, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
        running_updates(stream, ["user"], {"n": F.count(F.lit(1)), "total": F.sum("v")}, *args).awaitTermination()
        return {r.user: (r.n, r.total) for r in read_running_updates(spark, *args, ["user"]).collect()}

    assert deliver((1, "a", 1), (2, "b", 2), (3, None, 4)) == {"a": (1, 1), "b": (1, 2), None: (1, 4)}
    assert deliver((4, "b", 8)) == {"a": (1, 1), "b": (2, 10), None: (1, 4)}
    out = spark.read.parquet(f"{root}/out")
    assert {r.epoch: r["count"] for r in out.groupBy("epoch").count().collect()} == {0: 3, 1: 1}
    # rows of a batch that was never committed are not seen
    spark.createDataFrame([("x", 9, 9, 7)], "user string, n long, total long, epoch long").write.mode("append").partitionBy("epoch").parquet(f"{root}/out")
    want = {"a": (1, 1), "b": (2, 10), None: (1, 4)}
    read = lambda: {r.user: (r.n, r.total) for r in read_running_updates(spark, *args, ["user"]).collect()}
    assert read() == want and finished_epochs(spark, args[1]) == [0, 1]
    assert compact_running(spark, *args, ["user"]) == 1 and read() == want
    assert compact_running(spark, *args, ["user"]) == 0 and read() == want
    assert deliver((5, "a", 100)) == {"a": (2, 101), "b": (2, 10), None: (1, 4)}
