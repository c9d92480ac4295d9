import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import quarantined, retention_filter, tag_rejects, validated, write_validated
from tidewater.session import shared_dir
from tidewater.sources.events import EVENTS_SCHEMA

T = dt.datetime(2024, 1, 1)


def _bad_events(spark):
    rows = [
        (1, T, 1, "click", 1.0, '{"k": 1}'),
        (None, T, 1, "click", 1.0, '{"k": 1}'),
        (3, None, 1, "click", 1.0, '{"k": 1}'),
        (4, T, 1, "teleport", 1.0, '{"k": 1}'),
        (5, T, 1, "view", -2.0, '{"k": 1}'),
        (6, T, 1, "view", 2.0, '{"k": '),
    ]
    return spark.createDataFrame(rows, EVENTS_SCHEMA)


def test_one_reason_each(spark):
    got = [r.reject_reason for r in tag_rejects(_bad_events(spark)).collect()]
    assert got.count(None) == 1
    reasons = sorted(x for x in got if x)
    assert reasons == sorted(["missing_key", "missing_ts", "unknown_type", "bad_value", "bad_props"])


def test_valid_plus_quarantine_is_input(spark, sf_small):
    from tidewater.sources import read_table
    ev = read_table(spark, sf_small, "events").unionByName(_bad_events(spark))
    assert validated(ev).count() + quarantined(ev).count() == ev.count()


def test_write_validated_one_pass(spark):
    out = shared_dir(spark, "test-validated")
    write_validated(_bad_events(spark), out)
    back = spark.read.parquet(out)
    assert {(r.status, r.n) for r in back.groupBy("status").agg(F.count("*").alias("n")).collect()} \
        == {("valid", 1), ("quarantine", 5)}


def test_retention_idempotent(spark):
    rows = [(i, T + dt.timedelta(days=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    once = retention_filter(df, "ts", 7)
    assert sorted(r.id for r in once.collect()) == list(range(12, 20))
    assert sorted(retention_filter(once, "ts", 7).collect()) == sorted(once.collect())
