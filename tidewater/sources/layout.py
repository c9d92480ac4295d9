"""Storage layouts that save work later: tables bucketed by key, and tables
partitioned by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewater.functions.strings import valid_key
from tidewater.operators.names import unused_names
from tidewater.operators.relations import latest_by_key


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, mode: str = "overwrite") -> None:
    """Save a catalog table in ``buckets`` files by a hash of ``key``, sorted by
    it. Two tables with the same number of buckets meet on the key without a
    shuffle. Each task writes a file per bucket it has rows of, so the rows
    are brought together first: one file per bucket. A bucket should be a few
    hundred MB; rows without a key share one."""
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def upsert_bucketed(target: DataFrame, updates: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """``upsert_by_key`` for two tables bucketed by ``key`` alike (same columns,
    same number of buckets): updates are reduced to one row per key and merged
    bucket by bucket, with no Exchange. Target rows with a NULL or empty key
    stay; so do such updates, which are read apart."""
    cols = target.columns
    new = updates.select(*cols)
    usable = valid_key(key, isinstance(target.schema[key].dataType, StringType))
    by = list(order) if order else [c for c in cols if c != key]
    fresh = latest_by_key(new.filter(usable), key, by)
    t, tk, f, fk, row = unused_names("_t _tk _f _fk _row", target)
    left = target.select(F.struct(*cols).alias(t), F.col(key).alias(tk))
    right = fresh.select(F.struct(*cols).alias(f), F.col(key).alias(fk))
    merged = left.join(right, F.col(tk) == F.col(fk), "full_outer").select(F.coalesce(f, t).alias(row)).select(f"{row}.*")
    return merged.unionByName(new.filter(~F.coalesce(usable, F.lit(False))))


def save_by_day(df: DataFrame, name: str, ts: str, day_col: str = "day", mode: str = "overwrite") -> None:
    """Save a managed table partitioned by the day of ``ts``. Rows of a day are
    dealt over as many tasks as wrote them; NULL times share one partition."""
    df.withColumn(day_col, F.col(ts).cast("date")).write.mode(mode).partitionBy(day_col).saveAsTable(name)


def expire_days(spark: SparkSession, name: str, keep_days: int, day_col: str = "day") -> list[str]:
    """Drop the partitions of a table that are more than ``keep_days`` older
    than its newest one, without reading a row; returns their days. The list
    of partitions comes from the catalog (a row per day). Rows without a day
    stay."""
    days = sorted(r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect())
    days = [d for d in days if d != "__HIVE_DEFAULT_PARTITION__"]
    if not days:
        return []
    newest = F.lit(days[-1]).cast("date")
    old = [r.day for r in spark.createDataFrame([(d,) for d in days], "day string")
           .filter(F.col("day").cast("date") < F.date_sub(newest, keep_days)).orderBy("day").collect()]
    for d in old:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({day_col} = DATE'{d}')")
    return old


def on_days(fact: DataFrame, days: DataFrame, day_col: str = "day") -> DataFrame:
    """The rows of a day-partitioned table on the days of ``days`` (a filtered
    table with a column of that name). The planner hands the days to the scan
    at run time, so only their partitions are read, when ``days`` is small
    enough to be broadcast by its size; a larger one is joined as usual."""
    return fact.join(days.select(day_col).distinct(), day_col, "left_semi")
