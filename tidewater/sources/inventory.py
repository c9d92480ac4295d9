"""File inventory of a folder tree (object-store listing as a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_inventory(spark: SparkSession, root: str, prefix: str = "",
                   glob: str | None = None, base_uri: str | None = None) -> DataFrame:
    """One row per file under ``root`` whose name relative to ``root`` starts
    with ``prefix``: name, size, lastModified (timestamp), lastModifiedIso
    (ISO text with offset), full path, and ``uri`` = ``base_uri/name`` when a
    base (such as a bucket URI) is given.

    The ``binaryFile`` source lists files in parallel; because ``content`` is
    never selected, no file body is read. Spark's file sources leave out names
    that begin with ``_`` or ``.`` (markers and hidden files), and so does this
    listing; the tree is listed before the prefix is applied.
    """
    from tidewater.functions.times import iso_ts
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    root_uri = root.rstrip("/")
    files = reader.load(root_uri).select("path", "length", "modificationTime")
    # Paths come back fully qualified (file:/..., s3a://...); name is the part
    # after the root folder.
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _tail_pattern(root_uri) + "/", "")
    out = (files
           .select(rel.alias("name"),
                   F.col("length").alias("size"),
                   F.col("modificationTime").alias("lastModified"),
                   iso_ts("modificationTime", with_offset=True).alias("lastModifiedIso"),
                   F.col("path"))
           .filter(F.startswith(F.col("name"), F.lit(prefix))))
    if base_uri:
        out = out.withColumn("uri", F.concat(F.lit(base_uri.rstrip("/") + "/"), F.col("name")))
    return out


def _tail_pattern(root: str) -> str:
    """Regex for the root folder without its scheme, for stripping."""
    import re
    tail = root.split("://", 1)[-1]
    if tail.startswith("file:"):
        tail = tail[len("file:"):]
    return re.escape(tail.lstrip("/"))
