"""Named catalog tables: create, append, read.

The code takes table names only; which catalog serves them (the session
catalog, a Hive metastore, an Iceberg catalog) is configuration
(``spark.sql.catalog.*``, ``spark.sql.defaultCatalog``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a database (namespace) if missing; ``name`` may carry a catalog
    (``catalog.db``). With ``location`` its managed tables live in that
    shared folder instead of the warehouse default."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{where}")


def save_table(df: DataFrame, name: str, path: str | None = None,
               fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None) -> None:
    """Create (or replace) a table. With ``path`` the table is external and its
    files live in that shared folder."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """Append rows by column name (not position)."""
    target_columns = df.sparkSession.table(name).columns
    df.select(*target_columns).write.insertInto(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a table; the files of an external table stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_catalog_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
