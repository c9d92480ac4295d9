"""SQL text over registered tables (the SQL shell)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidewater.session import checkpoint_root
from tidewater.sources.files import TABLES, register_tables


def mentioned_tables(text: str, tables=TABLES) -> list[str]:
    """Tables whose name appears as a word in the text (only those need a
    view; each view costs a footer read at registration)."""
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text.lower()))
    return [t for t in tables if t.lower() in words]


def split_statements(text: str) -> list[str]:
    """The statements of a SQL text: split at semicolons outside of quotes
    ('...', "...", `...`) and comments (-- to the end of the line, /* ... */).
    Comments are left out, planner hints (/*+ ... */) stay."""
    parts = re.findall(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|.""", text, re.S)
    out = [""]
    for part in parts:
        if part == ";":
            out.append("")
        else:
            out[-1] += " " if part.startswith(("--", "/*")) and not part.startswith("/*+") and len(part) > 1 else part
    return [s.strip() for s in out if s.strip()]


@contextmanager
def table_views(spark: SparkSession, data_dir: str | None, names: list[str]):
    """The given parquet tables as temporary views for the time of the block.
    A view of the user with such a name stands again afterwards; results that
    were made inside keep the tables they were made from."""
    if data_dir is None:
        yield
        return
    before = {n: spark.table(n) for n in names
              if spark.catalog.tableExists(n) and spark.catalog.getTable(n).isTemporary}
    register_tables(spark, data_dir, names)
    try:
        yield
    finally:
        for n in names:
            if n in before:
                before[n].createOrReplaceTempView(n)
            else:
                spark.catalog.dropTempView(n)


@contextmanager
def held_settings(spark: SparkSession, settings: Mapping[str, str]):
    """The given session settings for the time of the block; those of the
    user stand again afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_sql(spark: SparkSession, text: str, data_dir: str | None = None,
            args: Mapping | None = None, tables=TABLES, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Run one SQL statement. With ``data_dir`` the given parquet tables that
    the text mentions are registered as views first; ``args`` binds
    ``:name`` parameters (no string pasting of values). ``settings`` hold
    while the statement runs; as Spark reads some only when it makes the rows,
    the result is then checkpointed at once."""
    with table_views(spark, data_dir, mentioned_tables(text, tables)), held_settings(spark, settings or {}):
        result = spark.sql(text, args=dict(args)) if args else spark.sql(text)
        if not settings:
            return result
        checkpoint_root(spark)
        return result.checkpoint()


def run_script(spark: SparkSession, statements: list[str], data_dir: str | None = None,
               args: Mapping | None = None, tables=TABLES) -> DataFrame:
    """Run statements in order (DDL, DML, ...); return the last result."""
    with table_views(spark, data_dir, mentioned_tables(" ".join(statements), tables)):
        result = None
        for text in statements:
            result = run_sql(spark, text, None, args)
        return result
