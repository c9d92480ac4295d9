"""The raw event stream: Kafka topic or a folder of files.

The payload of the topic is JSON with the columns of ``EVENTS_SCHEMA``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

EVENTS_SCHEMA = StructType([
    StructField("event_id", LongType()),
    StructField("ts", TimestampNTZType()),
    StructField("user_id", LongType()),
    StructField("event_type", StringType()),
    StructField("value", DoubleType()),
    StructField("props", StringType()),
])


#: Files that one micro-batch of a file stream takes at most, so that a first
#: run works through its backlog in steps.
FILES_PER_TRIGGER = 10_000


@dataclass(frozen=True)
class EventSourceSpec:
    """``kind`` is ``kafka`` (topic payloads) or ``files`` (parquet/json/csv
    files dropped into a folder). ``max_per_trigger`` bounds one micro-batch
    (offsets or files); without it a file stream takes ``FILES_PER_TRIGGER``."""

    kind: str = "files"
    path: str | None = None
    file_format: str = "parquet"
    topic: str = "raw-events"
    bootstrap_servers: str | None = None
    max_per_trigger: int | None = None
    options: Mapping[str, str] = field(default_factory=dict)


def event_source(spark: SparkSession, spec: EventSourceSpec,
                 schema: StructType = EVENTS_SCHEMA) -> DataFrame:
    """A streaming DataFrame of raw events.

    ``kafka`` yields Spark's standard Kafka rows (key, value, topic, partition,
    offset, timestamp, timestampType); decode ``value`` with
    ``tidewater.streaming.decode_events``. ``files`` yields rows of ``schema``,
    except for ``file_format="text"``: one payload line per row in ``value``,
    decoded the same way as topic values.
    """
    if spec.kind == "kafka":
        reader = (spark.readStream.format("kafka")
                  .option("subscribe", spec.topic)
                  .option("kafka.bootstrap.servers", spec.bootstrap_servers or "")
                  .option("startingOffsets", "earliest"))
        if spec.max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", str(spec.max_per_trigger))
        return reader.options(**dict(spec.options)).load()
    if spec.kind == "files":
        reader = spark.readStream.format(spec.file_format)
        if spec.file_format != "text":  # text files are payload lines: one `value` column
            reader = reader.schema(schema)
        reader = reader.option("maxFilesPerTrigger", str(spec.max_per_trigger or FILES_PER_TRIGGER))
        return reader.options(**dict(spec.options)).load(spec.path)
    raise ValueError(f"unknown event source kind: {spec.kind}")
