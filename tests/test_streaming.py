import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewater.session import shared_dir
from tidewater.sources.events import EventSourceSpec, event_source
from tidewater.streaming import (bronze_ingest, decode_events, encode_events,
                                 read_running_result, running_aggregate, validate_stream)


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def _split_events(sf_small, folder, parts=4):
    table = pq.read_table(f"{sf_small}/events.parquet")
    n = table.num_rows
    bounds = [n * i // parts for i in range(parts + 1)]
    return [table.slice(bounds[i], bounds[i + 1] - bounds[i]) for i in range(parts)]


def test_bronze_batches_and_restart(spark, sf_small):
    root = shared_dir(spark, "test-bronze")
    src = _local(root) + "/in"
    os.makedirs(src)
    pieces = _split_events(sf_small, src)
    for i in range(3):
        pq.write_table(pieces[i], f"{src}/events-{i}.parquet")
    spec = EventSourceSpec(kind="files", path=src, max_per_trigger=1)
    q = bronze_ingest(event_source(spark, spec), f"{root}/table", f"{root}/_ckpt")
    q.awaitTermination()
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) == 3
    assert [b["observedMetrics"]["bronze"]["rows"] for b in batches] == \
        [p.num_rows for p in pieces[:3]]
    first = spark.read.parquet(f"{root}/table").count()
    assert first == sum(p.num_rows for p in pieces[:3])

    # Restart with the same checkpoint after a fourth file arrives.
    pq.write_table(pieces[3], f"{src}/events-3.parquet")
    q2 = bronze_ingest(event_source(spark, spec), f"{root}/table", f"{root}/_ckpt")
    q2.awaitTermination()
    added = sum(p["numInputRows"] for p in q2.recentProgress)
    assert added == pieces[3].num_rows
    back = spark.read.parquet(f"{root}/table").drop("ingest_ts")
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    assert back.count() == ev.count()
    assert back.exceptAll(ev).count() == 0 and ev.exceptAll(back).count() == 0

    # A third run over the same input adds nothing.
    q3 = bronze_ingest(event_source(spark, spec), f"{root}/table", f"{root}/_ckpt")
    q3.awaitTermination()
    assert spark.read.parquet(f"{root}/table").count() == ev.count()


def test_running_agg_equals_batch(spark, sf_small):
    root = shared_dir(spark, "test-running")
    src = _local(root) + "/in"
    os.makedirs(src)
    for i, piece in enumerate(_split_events(sf_small, src, 3)):
        pq.write_table(piece, f"{src}/events-{i}.parquet")
    spec = EventSourceSpec(kind="files", path=src, max_per_trigger=1)
    q = running_aggregate(event_source(spark, spec), ["event_type"],
                          {"n": F.count(F.lit(1)), "total": F.sum("value")},
                          f"{root}/out", f"{root}/_ckpt")
    q.awaitTermination()
    written = spark.read.parquet(f"{root}/out")
    assert sorted(r.slot for r in written.select("slot").distinct().collect()) == [0, 1]
    got = {r.event_type: (r.n, round(r.total, 6))
           for r in read_running_result(spark, f"{root}/out").collect()}
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    want = {r.event_type: (r.n, round(r.total, 6)) for r in ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
    assert got == want


def test_validate_stream(spark, sf_small):
    root = shared_dir(spark, "test-vstream")
    src = _local(root) + "/in"
    os.makedirs(src)
    pq.write_table(pq.read_table(f"{sf_small}/events.parquet"), f"{src}/e.parquet")
    q = validate_stream(event_source(spark, EventSourceSpec(kind="files", path=src)),
                        f"{root}/out", f"{root}/_ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    assert out.filter("status = 'valid'").count() == 1000
    metrics = [p["observedMetrics"]["validation"] for p in q.recentProgress
               if p["numInputRows"] > 0]
    assert sum(m["rows"] for m in metrics) == 1000 and sum(m["rejected"] for m in metrics) == 0


def test_decode_roundtrip_and_bad_payload(spark, sf_small):
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    back = decode_events(encode_events(ev))
    assert back.exceptAll(ev).count() == 0
    bad = spark.createDataFrame([("k", "not json")], "key string, value string")
    r = decode_events(bad).collect()[0]
    assert r.event_id is None and r.ts is None


def test_kafka_source_needs_connector(spark):
    """The Kafka reader is wired; without the connector jar Spark says so."""
    import pytest
    from pyspark.errors import AnalysisException
    spec = EventSourceSpec(kind="kafka", bootstrap_servers="localhost:1")
    try:
        df = event_source(spark, spec)
    except AnalysisException as e:
        assert "kafka" in str(e).lower()
        return
    assert {"key", "value", "topic", "partition", "offset"} <= set(df.columns)
    pytest.skip("Kafka connector present")


def test_processing_time_trigger(spark, sf_small):
    """The polling interval path: a running query picks up files, then stops."""
    root = shared_dir(spark, "test-poll")
    src = _local(root) + "/in"
    os.makedirs(src)
    pq.write_table(pq.read_table(f"{sf_small}/events.parquet"), f"{src}/e.parquet")
    spec = EventSourceSpec(kind="files", path=src)
    q = bronze_ingest(event_source(spark, spec), f"{root}/table", f"{root}/_ckpt",
                      trigger="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(f"{root}/table").count() == 1000


def test_bronze_into_three_part_table(spark, sf_small):
    """Stream into <catalog>.<database>.<table>, as a bronze table is named."""
    from tidewater.sources import ensure_database
    root = shared_dir(spark, "test-bronze-table")
    ensure_database(spark, "spark_catalog.tw_bronze", f"{root}/db")
    src = _local(root) + "/in"
    os.makedirs(src)
    pq.write_table(pq.read_table(f"{sf_small}/events.parquet"), f"{src}/e.parquet")
    name = "spark_catalog.tw_bronze.raw_events_" + root.rsplit("-", 1)[-1]
    q = bronze_ingest(event_source(spark, EventSourceSpec(kind="files", path=src)), None,
                      f"{root}/_ckpt", table=name)
    q.awaitTermination()
    assert spark.table(name).count() == 1000
    assert "ingest_ts" in spark.table(name).columns
