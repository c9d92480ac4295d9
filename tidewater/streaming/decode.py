"""Topic payloads <-> typed event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.sources.events import EVENTS_SCHEMA


# Timestamps are written with full microseconds (the JSON default keeps
# millis) and read with one to six fraction digits or none.
JSON_OPTIONS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
}

# Columns of a topic row beside its payload.
TOPIC_COLUMNS = ("key", "topic", "partition", "offset", "timestamp")


def encode_events(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows -> (key, value) JSON text, the shape a topic carries."""
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                               JSON_OPTIONS).alias("value"))


def decode_events(df: DataFrame, schema: StructType = EVENTS_SCHEMA,
                  value_col: str = "value", keep_raw: bool = False) -> DataFrame:
    """Parse the JSON payload (string or bytes) with an explicit schema. A
    payload that is not JSON gives a row of NULLs, which validation rejects.
    With ``keep_raw`` the payload stays as ``raw``, and what else the topic
    row carries (key, topic, partition, offset, timestamp) as ``topic_<name>``,
    so no event is lost to a broken payload."""
    payload = F.col(value_col).cast("string")
    kept = []
    if keep_raw:
        kept = [payload.alias("raw")]
        for c in TOPIC_COLUMNS:
            if c in df.columns:
                col = F.col(c).cast("string") if c == "key" else F.col(c)
                kept.append(col.alias(f"topic_{c}"))
    parsed = F.from_json(payload, schema, JSON_OPTIONS).alias("_e")
    names = [c for c in df.select(*kept).columns] if kept else []
    return df.select(parsed, *kept).select("_e.*", *names)
