"""Command-line jobs built from the operators.

    python -m tidewater.jobs counter  [--n 100000] [--parts 10]
    python -m tidewater.jobs inspect  --path <csv folder> [--format csv]
    python -m tidewater.jobs wordcount --path <text or parquet> --out <folder> [--column text]
    python -m tidewater.jobs bronze   (--source <folder> | --kafka <servers> [--topic raw-events])
                                      (--out <folder> | --table <name>) --checkpoint <folder>
                                      [--trigger "30 seconds" | availableNow]
    python -m tidewater.jobs validate (--source <folder> | --kafka <servers> [--topic raw-events])
                                      --out <folder> --checkpoint <folder> [--trigger ...]
    python -m tidewater.jobs dedup    (--source <folder> | --kafka <servers>) --out <folder> --checkpoint <folder>
                                      --delay "10 minutes" [--key event_id]
    python -m tidewater.jobs windows  (--source <folder> | --kafka <servers>) --out <folder> --checkpoint <folder>
                                      --delay "10 minutes" (--size "1 hour" [--slide "10 minutes"] | --gap "30 minutes")
                                      [--by event_type,user_id]
    python -m tidewater.jobs silent   (--source <folder> | --kafka <servers>) --out <folder> --checkpoint <folder>
                                      --delay "10 minutes" --quiet "1 hour" [--key user_id]
    python -m tidewater.jobs csvlines --path <csv folder> --schema "id INT, name STRING" --out <folder>
    python -m tidewater.jobs history  --logs <event-log folder> --out <folder>
    python -m tidewater.jobs sql      --data-dir <folder of parquet tables>
                                      (--query "<SQL>" | --file <file.sql>) [--out <folder>]
    python -m tidewater.jobs reconcile --desired <path> --actual <path> --key <column>
                                      --out <folder> [--format parquet]

The master and cluster settings come from the launcher (spark-submit).
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators import (agg_by_map, app_summary, describe_schema, range_stats,
                                 reconcile, word_count)
from tidewater.plans.sql import run_script, split_statements
from tidewater.session import get_spark
from tidewater.sources.files import parquet_names
from tidewater.sources import (EventSourceSpec, SourceSpec, event_source, load_source,
                               read_event_log)
from tidewater.sources.csvlines import broken_lines, csv_report, read_csv_lines, sound_rows
from tidewater.streaming import (append_stream, bronze_ingest, decode_events, first_deliveries, session_totals, silent_keys,
                                 stream_counts, validate_stream, window_totals)


def counter(spark: SparkSession, n: int = 100_000, parts: int = 10) -> dict:
    """Statistics of 1..n-1 in one pass, then the parity table of 1..100
    grouped by type. Returns the numbers it prints."""
    start = time.perf_counter()
    stats = range_stats(spark, n, parts).first().asDict()
    for label, key, fmt in (("count", "n", ",d"), ("mean", "mean", ",.2f"),
                            ("min", "min_value", ",.2f"), ("max", "max_value", ",.2f"),
                            ("even", "even", ",d"), ("odd", "odd", ",d")):
        print(f"{label:>6}  {stats[key]:{fmt}}")
    num = F.col("id")
    parity = spark.range(1, 101).select(
        num.alias("number"), (num * 2).alias("doubled"),
        F.when(num % 2 == 0, "even").otherwise("odd").alias("type"))
    parity.show(5)
    grouped = agg_by_map(parity, ["type"], {"number": "sum", "doubled": "avg"})
    grouped.show()
    print(f"elapsed  {time.perf_counter() - start:.2f} s")
    return stats


def inspect(spark: SparkSession, spec: SourceSpec, rows: int = 10) -> DataFrame:
    """Schema, the first rows, and the analyzed schema of a configured source."""
    df = load_source(spark, spec)
    df.printSchema()
    df.show(rows)
    describe_schema(df).show(truncate=False)
    return df


def wordcount(spark: SparkSession, spec: SourceSpec, out: str, column: str = "text") -> None:
    """Word counts of a text column written as parquet."""
    df = load_source(spark, spec)
    if spec.format == "text":
        df = df.withColumnRenamed("value", column)
    word_count(df, column).write.mode("overwrite").parquet(out)


def event_spec(source: str | None, kafka: str | None, topic: str = "raw-events",
               file_format: str = "parquet") -> EventSourceSpec:
    """A topic when bootstrap servers are given, else a folder of files."""
    if kafka:
        return EventSourceSpec(kind="kafka", topic=topic, bootstrap_servers=kafka)
    return EventSourceSpec(kind="files", path=source, file_format=file_format)


def events_of(spark: SparkSession, spec: EventSourceSpec, keep_raw: bool = False) -> DataFrame:
    """The stream of typed events; topic values and text lines are decoded."""
    stream = event_source(spark, spec)
    payloads = spec.kind == "kafka" or spec.file_format == "text"
    return decode_events(stream, keep_raw=keep_raw) if payloads else stream


def bronze(spark: SparkSession, source: str | None, out: str | None, checkpoint: str,
           trigger: str | None = None, file_format: str = "parquet", kafka: str | None = None,
           topic: str = "raw-events", table: str | None = None) -> None:
    """Raw events of a topic or folder appended to the bronze folder or table,
    with the raw payload and what the topic says of it."""
    stream = events_of(spark, event_spec(source, kafka, topic, file_format), keep_raw=True)
    bronze_ingest(stream, out, checkpoint, table=table, trigger=trigger).awaitTermination()


def validate(spark: SparkSession, source: str | None, out: str, checkpoint: str,
             trigger: str | None = None, file_format: str = "parquet", kafka: str | None = None,
             topic: str = "raw-events") -> None:
    """Events appended under ``status=valid`` or ``status=quarantine``, with
    their raw payload where there is one."""
    stream = events_of(spark, event_spec(source, kafka, topic, file_format), keep_raw=True)
    validate_stream(stream, out, checkpoint, trigger=trigger).awaitTermination()


def _append(stream: DataFrame, out: str, checkpoint: str, trigger: str | None) -> dict:
    """Run an append stream to its end (or for good) and print its counts."""
    q = append_stream(stream, out, checkpoint, trigger)
    q.awaitTermination()
    counts = stream_counts(q)
    print(" ".join(f"{k}={v:,}" for k, v in counts.items()))
    return counts


def dedup(spark: SparkSession, spec: EventSourceSpec, out: str, checkpoint: str, delay: str,
          key: str = "event_id", trigger: str | None = None) -> dict:
    """Events without repeated deliveries; the counts of repeats and of rows
    that came too late are printed."""
    events = events_of(spark, spec, keep_raw=True)
    return _append(first_deliveries(events, key.split(","), "ts", delay), out, checkpoint, trigger)


def windows(spark: SparkSession, spec: EventSourceSpec, out: str, checkpoint: str, delay: str, size: str | None = None,
            slide: str | None = None, gap: str | None = None, by: str = "event_type", trigger: str | None = None) -> dict:
    """Number and sum of values per window (``size``, ``slide``) or session
    (``gap``) and the columns of ``by``, each written once it is closed."""
    keys = [k for k in by.split(",") if k]
    totals = {"n": F.count(F.lit(1)), "total_value": F.sum(F.col("value").cast("decimal(18,2)"))}
    events = events_of(spark, spec)
    out_rows = session_totals(events, "ts", delay, totals, gap, keys) if gap else window_totals(events, "ts", delay, totals, size, slide, keys)
    return _append(out_rows, out, checkpoint, trigger)


def silent(spark: SparkSession, spec: EventSourceSpec, out: str, checkpoint: str, delay: str, quiet: str,
           key: str = "user_id", trigger: str | None = None) -> dict:
    """Keys without an event for ``quiet``, once per silence."""
    return _append(silent_keys(events_of(spark, spec), key, "ts", quiet, delay), out, checkpoint, trigger)


def csvlines(spark: SparkSession, path: str, schema: str, out: str) -> DataFrame:
    """A CSV folder with a header per file, read with a declared schema: sound
    rows under ``rows``, lines that don't fit under ``broken``, and the number
    of both per file shown."""
    lines = read_csv_lines(spark, path, StructType.fromDDL(schema))
    sound_rows(lines).write.mode("overwrite").parquet(f"{out}/rows")
    broken_lines(lines).write.mode("overwrite").parquet(f"{out}/broken")
    report = csv_report(lines)
    report.orderBy("source_file").show(truncate=False)
    return report


def history(spark: SparkSession, logs: str, out: str) -> None:
    """Per-application summaries of an event-log folder written as parquet."""
    app_summary(read_event_log(spark, logs)).write.mode("overwrite").parquet(out)


def sql(spark: SparkSession, data_dir: str | None, text: str, out: str | None = None,
        show: int = 20) -> DataFrame:
    """SQL text (statements separated by ';') over the parquet tables of
    ``data_dir``, on any file system: those whose names the text mentions are
    views while it runs. The last result is shown or written as parquet."""
    names = parquet_names(spark, data_dir) if data_dir else []
    result = run_script(spark, split_statements(text), data_dir, tables=names)
    if out:
        result.write.mode("overwrite").parquet(out)
    else:
        result.show(show, truncate=False)
    return result


def reconcile_job(spark: SparkSession, desired: SourceSpec, actual: SourceSpec, key: str,
                  out: str) -> None:
    """The create / keep / delete plan per key, written as parquet."""
    plan = reconcile(load_source(spark, desired), load_source(spark, actual), key)
    plan.write.mode("overwrite").parquet(out)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tidewater.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    c = sub.add_parser("counter")
    c.add_argument("--n", type=int, default=100_000)
    c.add_argument("--parts", type=int, default=10)
    i = sub.add_parser("inspect")
    i.add_argument("--path", required=True)
    i.add_argument("--format", default="csv")
    w = sub.add_parser("wordcount")
    w.add_argument("--path", required=True)
    w.add_argument("--format", default="text")
    w.add_argument("--column", default="text")
    w.add_argument("--out", required=True)
    for name in ("bronze", "validate"):
        b = sub.add_parser(name)
        where = b.add_mutually_exclusive_group(required=True)
        where.add_argument("--source")
        where.add_argument("--kafka", help="bootstrap servers")
        b.add_argument("--topic", default="raw-events")
        b.add_argument("--format", default="parquet")
        b.add_argument("--checkpoint", required=True)
        b.add_argument("--trigger", default=None)
        sink = b.add_mutually_exclusive_group(required=True)
        sink.add_argument("--out")
        if name == "bronze":
            sink.add_argument("--table")
    for name in ("dedup", "windows", "silent"):
        b = sub.add_parser(name)
        where = b.add_mutually_exclusive_group(required=True)
        where.add_argument("--source")
        where.add_argument("--kafka", help="bootstrap servers")
        b.add_argument("--topic", default="raw-events")
        b.add_argument("--format", default="parquet")
        b.add_argument("--out", required=True)
        b.add_argument("--checkpoint", required=True)
        b.add_argument("--delay", required=True)
        b.add_argument("--trigger", default=None)
        if name == "windows":
            kind = b.add_mutually_exclusive_group(required=True)
            kind.add_argument("--size")
            kind.add_argument("--gap")
            b.add_argument("--slide", default=None)
            b.add_argument("--by", default="event_type")
        else:
            b.add_argument("--key", default="event_id" if name == "dedup" else "user_id")
        if name == "silent":
            b.add_argument("--quiet", required=True)
    v = sub.add_parser("csvlines")
    v.add_argument("--path", required=True)
    v.add_argument("--schema", required=True)
    v.add_argument("--out", required=True)
    h = sub.add_parser("history")
    h.add_argument("--logs", required=True)
    h.add_argument("--out", required=True)
    q = sub.add_parser("sql")
    q.add_argument("--data-dir", default=None)
    q.add_argument("--query", default=None)
    q.add_argument("--file", default=None)
    q.add_argument("--out", default=None)
    r = sub.add_parser("reconcile")
    r.add_argument("--desired", required=True)
    r.add_argument("--actual", required=True)
    r.add_argument("--key", required=True)
    r.add_argument("--format", default="parquet")
    r.add_argument("--out", required=True)
    a = p.parse_args(argv)

    spark = get_spark(f"tidewater-{a.job}")
    if a.job == "counter":
        counter(spark, a.n, a.parts)
    elif a.job == "inspect":
        inspect(spark, SourceSpec.from_config(
            {"app": {"name": "inspect", "file": {"inputPath": a.path, "format": a.format}}}))
    elif a.job == "wordcount":
        wordcount(spark, SourceSpec(a.format, a.path), a.out, a.column)
    elif a.job == "bronze":
        bronze(spark, a.source, a.out, a.checkpoint, a.trigger, a.format, a.kafka, a.topic, a.table)
    elif a.job == "validate":
        validate(spark, a.source, a.out, a.checkpoint, a.trigger, a.format, a.kafka, a.topic)
    elif a.job in ("dedup", "windows", "silent"):
        to = (event_spec(a.source, a.kafka, a.topic, a.format), a.out, a.checkpoint, a.delay)
        if a.job == "dedup":
            dedup(spark, *to, key=a.key, trigger=a.trigger)
        elif a.job == "silent":
            silent(spark, *to, quiet=a.quiet, key=a.key, trigger=a.trigger)
        else:
            windows(spark, *to, size=a.size, slide=a.slide, gap=a.gap, by=a.by, trigger=a.trigger)
    elif a.job == "csvlines":
        csvlines(spark, a.path, a.schema, a.out)
    elif a.job == "history":
        history(spark, a.logs, a.out)
    elif a.job == "sql":
        text = a.query if a.query else open(a.file).read()
        sql(spark, a.data_dir, text, a.out)
    elif a.job == "reconcile":
        reconcile_job(spark, SourceSpec(a.format, a.desired), SourceSpec(a.format, a.actual),
                      a.key, a.out)


if __name__ == "__main__":
    main()
