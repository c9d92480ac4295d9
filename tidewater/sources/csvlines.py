"""CSV folders with broken lines: nothing is lost, and every file says how
many of its lines could not be read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


#: Columns that are added to those of the schema.
LINE, FILE = "corrupt_line", "source_file"


def read_csv_lines(spark: SparkSession, path: str, schema: StructType, options: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of ``schema`` from a CSV file or folder with a header per file,
    with the file's name and, for a line that does not fit the schema (too
    short, too long, or a value of another type), its whole text in
    ``corrupt_line`` (NULL for a sound line).

    Types are declared, not inferred: one pass over the data. All columns are
    parsed, since Spark judges a line by the columns it reads."""
    taken = {f.name.lower() for f in schema.fields}
    if {LINE, FILE} & taken:
        raise ValueError(f"the schema must not have columns {LINE} or {FILE}")
    raw = "_raw"
    while raw in taken:
        raw = f"_{raw}"
    whole = StructType([*schema.fields, StructField(raw, StringType())])
    settings = {"header": "true"} | dict(options or {}) | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw}
    read = spark.read.schema(whole).options(**settings).csv(path)
    # Always true, but not for the optimizer: whoever reads the line or its
    # absence reads all columns, by which it is judged.
    parsed = F.length(F.concat_ws("", *[F.col(f.name).cast("string") for f in schema.fields])) >= 0
    return read.select(*schema.names, F.when(parsed, F.col(raw)).alias(LINE), F.col("_metadata.file_name").alias(FILE))


def csv_report(lines: DataFrame) -> DataFrame:
    """source_file, n_lines, n_sound, n_broken per file that has a line."""
    return lines.groupBy(FILE).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col(LINE).isNull()).alias("n_sound"),
                                   F.count_if(F.col(LINE).isNotNull()).alias("n_broken"))


def sound_rows(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col(LINE).isNull()).drop(LINE, FILE)


def broken_lines(lines: DataFrame, separator: str = ",") -> DataFrame:
    """source_file, corrupt_line, reason of the lines that were not read:
    ``short`` or ``long`` by the number of separators, else ``type``. Quoted
    separators count too, so the reason is a hint, the line the evidence."""
    wanted = len(lines.columns) - 3  # separators between the schema's columns
    n = F.length(LINE) - F.length(F.replace(F.col(LINE), F.lit(separator), F.lit("")))
    reason = F.when(n < wanted, "short").when(n > wanted, "long").otherwise("type")
    return lines.filter(F.col(LINE).isNotNull()).select(FILE, LINE, reason.alias("reason"))
