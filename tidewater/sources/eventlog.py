"""Spark application event logs (JSON lines) as a table.

Write logs with ``spark.eventLog.enabled=true``, ``spark.eventLog.dir=<dir>``.
Plain logs and those whose file names end in a compression suffix that Spark's
text source knows (.zstd, .lz4, .gz) can be read.
Each file holds one application; rolling logs keep one folder per application.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Only the fields the summaries use; all others are skipped by the parser.
EVENT_FIELDS = """
    `Event` STRING,
    `App ID` STRING,
    `App Name` STRING,
    `Timestamp` BIGINT,
    `Job ID` BIGINT,
    `Submission Time` BIGINT,
    `Completion Time` BIGINT,
    `Job Result` STRUCT<`Result`: STRING>,
    `Stage ID` BIGINT,
    `Stage Attempt ID` BIGINT,
    `Stage Info` STRUCT<`Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT,
        `Stage Name`: STRING, `Number of Tasks`: BIGINT, `Submission Time`: BIGINT,
        `Completion Time`: BIGINT, `Failure Reason`: STRING>,
    `Task End Reason` STRUCT<`Reason`: STRING>,
    `Task Info` STRUCT<`Launch Time`: BIGINT, `Finish Time`: BIGINT, `Failed`: BOOLEAN,
        `Killed`: BOOLEAN>,
    `Task Metrics` STRUCT<`Executor Run Time`: BIGINT, `Executor CPU Time`: BIGINT,
        `Input Metrics`: STRUCT<`Records Read`: BIGINT, `Bytes Read`: BIGINT>,
        `Shuffle Read Metrics`: STRUCT<`Total Records Read`: BIGINT>,
        `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>>
"""


def read_event_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """One row per event: ``log_file`` identifies the application (the log
    file, or the ``eventlog_v2_*`` folder of a rolling log), then the event
    kind and the parsed fields. Lines that are not JSON get ``Event`` NULL."""
    path = F.col("_metadata.file_path")
    rolling = F.regexp_extract(path, r"^(.*/eventlog_v2_[^/]+)/[^/]+$", 1)
    app = F.when(rolling != "", rolling).otherwise(
        F.regexp_replace(path, r"\.inprogress$", ""))
    lines = (spark.read.option("recursiveFileLookup", "true")
             .text(log_dir)
             .select(app.alias("log_file"), "value"))
    parsed = F.from_json("value", EVENT_FIELDS, {"mode": "PERMISSIVE"})
    return lines.select("log_file", parsed.alias("e")).select("log_file", "e.*")
