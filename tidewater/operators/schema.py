"""Schema description and ordered heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

SCHEMA_DESCRIPTION = StructType([
    StructField("position", IntegerType(), False),
    StructField("column_name", StringType(), False),
    StructField("data_type", StringType(), False),
    StructField("nullable", BooleanType(), False),
])


def describe_schema(df: DataFrame, count_values: bool = False) -> DataFrame:
    """The resolved (analyzed) schema as a table: one row per top-level
    column (position, name, type, nullable). Without ``count_values`` only
    the schema travels and no data is read. With it, ``non_null`` counts the
    values of each column in ONE aggregate pass; the single result row is
    exploded into one row per column (no join)."""
    fields = list(df.schema.fields)
    if not count_values:
        rows = [(i, f.name, f.dataType.simpleString(), f.nullable)
                for i, f in enumerate(fields, start=1)]
        return df.sparkSession.createDataFrame(rows, SCHEMA_DESCRIPTION)
    counts = df.agg(*[F.count(df[f.name]).alias(f"_c{i}") for i, f in enumerate(fields, 1)])
    per_column = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                           F.lit(f.dataType.simpleString()).alias("data_type"),
                           F.lit(f.nullable).alias("nullable"),
                           F.col(f"_c{i}").alias("non_null"))
                  for i, f in enumerate(fields, 1)]
    return counts.select(F.explode(F.array(*per_column)).alias("r")).select("r.*")


def head_n(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in a total order (TakeOrderedAndProject: each task
    keeps its own top ``n``, only those are merged)."""
    return df.orderBy(*order).limit(n)
