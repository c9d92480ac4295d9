"""A source chosen by configuration: format, path, options and schema."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


@dataclass(frozen=True)
class SourceSpec:
    """What to read. ``schema`` avoids the extra inference pass over the data;
    without it CSV and JSON sources infer types first (one more scan)."""

    format: str
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    schema: StructType | str | None = None
    table: str | None = None

    @staticmethod
    def from_config(conf: Mapping) -> "SourceSpec":
        """Build a spec from an application config tree such as
        ``{"app": {"name": ..., "file": {"inputPath": ..., "format": "csv"}}}``.
        CSV with header and inference is the default, as in the original job."""
        app = conf.get("app", conf)
        file_conf = app.get("file", {})
        fmt = file_conf.get("format", "csv")
        options = dict(file_conf.get("options", {}))
        if fmt == "csv":
            options.setdefault("header", "true")
            if "schema" not in file_conf:
                options.setdefault("inferSchema", "true")
        return SourceSpec(format=fmt, path=file_conf.get("inputPath"), options=options,
                          schema=file_conf.get("schema"), table=file_conf.get("table"))


def load_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Read a batch source. Paths may use any Hadoop scheme (``s3a://``,
    ``hdfs://``, ``file:``); credentials come from ``spark.hadoop.*`` settings.
    ``format="table"`` reads a catalog table by name."""
    if spec.format == "table":
        return spark.table(spec.table or spec.path)
    reader = spark.read.format(spec.format).options(**dict(spec.options))
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    if spec.format == "binaryFile":
        return reader.load(spec.path)
    return reader.load(spec.path) if spec.path else reader.load()


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


def parquet_names(spark: SparkSession, data_dir: str) -> list[str]:
    """Names of the ``<name>.parquet`` files and folders of a folder on any
    Hadoop file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(data_dir)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in files]
    return sorted(n[:-len(".parquet")] for n in names if n.endswith(".parquet"))


def register_tables(spark: SparkSession, data_dir: str, names=TABLES) -> None:
    """Register the given parquet tables as temporary views for SQL text."""
    for name in names:
        read_table(spark, data_dir, name).createOrReplaceTempView(name)
