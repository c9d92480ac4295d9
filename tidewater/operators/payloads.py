"""Payloads of unknown shape as VARIANT values: parsed once, read without a
declared schema, their merged schema found by an aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_payloads(df: DataFrame, payload: str, out: str = "payload_v", broken: str = "payload_broken") -> DataFrame:
    """``df`` with the JSON text of ``payload`` as a VARIANT in ``out`` and
    whether it is broken (text that is no JSON) in ``broken``. A NULL payload
    is not broken; both kinds have a NULL variant. The text column stays, so a
    broken payload is not lost."""
    parsed = df.withColumn(out, F.try_parse_json(F.col(payload)))
    return parsed.withColumn(broken, F.col(payload).isNotNull() & F.col(out).isNull())


def payload_fields(df: DataFrame, variant: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for every entry of ``fields``: name to (JSON path,
    type). A field that is missing, or of another type, is NULL; one that is
    numeric text is cast where its type says a number."""
    return df.withColumns({name: F.try_variant_get(F.col(variant), path, kind) for name, (path, kind) in fields.items()})


def merged_schema(df: DataFrame, variant: str, keys: Sequence[str] = ()) -> DataFrame:
    """The schema that holds every payload (of each key): fields of all of
    them, types widened until they fit. Schemas are merged in each task, so
    one schema per key and task is shuffled."""
    return df.groupBy(*keys).agg(F.schema_of_variant_agg(F.col(variant)).alias("payload_schema"), F.count(F.col(variant)).alias("n"))


def payload_report(df: DataFrame, payload: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n_rows, n_missing, n_broken, n_read: what became of the payloads."""
    parsed = parse_payloads(df.select(*keys, F.col(payload).alias("_p")), "_p", "_v", "_b")
    return parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_p").isNull()).alias("n_missing"),
        F.count_if(F.col("_b")).alias("n_broken"), F.count_if(F.col("_v").isNotNull()).alias("n_read"))
