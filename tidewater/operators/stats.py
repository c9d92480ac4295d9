"""One-pass statistics and grouped aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidewater.functions.labels import SPARK_KEYS, has_any_key


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c) -> Column:
    """Sum of an integral column as DECIMAL(38,0), NULL if all values are NULL.

    A BIGINT sum overflows at 2**63. Here the four 16-bit parts of the values
    are summed as BIGINT (safe up to 2**47 rows) and put together at the end,
    so the rows themselves stay in whole-stage codegen without decimals."""
    x = _col(c).cast("bigint")
    parts = [F.shiftright(x, 48), *[F.shiftright(x, s).bitwiseAND(F.lit(0xFFFF)) for s in (32, 16, 0)]]
    total = F.lit(0).cast("decimal(38,0)")
    for part, shift in zip(parts, (48, 32, 16, 0)):
        total = total + (F.sum(part).cast("decimal(20,0)") * F.lit(1 << shift).cast("decimal(16,0)"))
    return total.cast("decimal(38,0)")


def _sum(df: DataFrame, c: str) -> Column:
    return exact_sum(c) if isinstance(df.schema[c].dataType, IntegralType) else F.sum(c)


def one_pass_stats(df: DataFrame, c) -> DataFrame:
    """count, sum, mean, min, max and even/odd counts of an integral column in
    ONE aggregate (one scan, partial aggregation per partition). Odd uses
    ``% 2 != 0`` so negative odd numbers count too."""
    x = _col(c)
    return df.agg(
        F.count(x).alias("n"),
        exact_sum(x).alias("total"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min_value"),
        F.max(x).alias("max_value"),
        F.count_if(x % 2 == 0).alias("even"),
        F.count_if(x % 2 != 0).alias("odd"),
    )


def range_stats(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """Statistics of the sequence 1 .. n-1 (end-exclusive, like ``range``).
    The sequence is generated on the executors, never on the driver."""
    seq = spark.range(1, n, 1, parts) if parts else spark.range(1, n)
    return one_pass_stats(seq, "id")


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``count(*)`` plus one ``count_if`` per named condition, one pass."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.count_if(cond).alias(name) for name, cond in conditions.items()])


_AGG_FUNCS = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max,
    "count": F.count, "first": F.first, "last": F.last,
    "count_distinct": F.count_distinct, "stddev": F.stddev, "variance": F.variance,
}


def agg_by_map(df: DataFrame, keys: Sequence[str], spec: Mapping[str, str]) -> DataFrame:
    """Group by ``keys`` and apply ``{column: function}``; outputs are named
    ``<function>_<column>`` in the order of ``spec``. Sums of integral columns
    are exact (DECIMAL(38,0))."""
    aggs = []
    for column, fn in spec.items():
        if fn not in _AGG_FUNCS:
            raise ValueError(f"unknown aggregate {fn!r}")
        agg = _sum(df, column) if fn == "sum" else _AGG_FUNCS[fn](F.col(column))
        aggs.append(agg.alias(f"{fn}_{column}"))
    return df.groupBy(*keys).agg(*aggs)


def format_stats(df: DataFrame, c, decimals: int = 2) -> DataFrame:
    """Count with thousands separators and the mean with ``decimals`` places."""
    return df.agg(F.format_number(F.count(F.lit(1)), 0).alias("count_text"),
                  F.format_number(F.avg(_col(c)), decimals).alias("mean_text"))


def status_metrics(pods: DataFrame, apps: DataFrame, status: str = "status",
                   labels: str = "labels", state: str = "state",
                   spark_keys: Sequence[str] = SPARK_KEYS) -> DataFrame:
    """Dashboard counters over two tables in one aggregate: the two inputs are
    tagged and unioned (no join), then counted in one pass.

    running: pod status ``running`` in any case; active apps: state ``RUNNING``;
    failed: failed pods plus FAILED apps (``error`` is not counted); spark and
    infra pods by label keys."""
    p = pods.select(F.lit(True).alias("is_pod"),
                    F.lower(F.coalesce(F.col(status), F.lit(""))).alias("s"),
                    has_any_key(labels, spark_keys).alias("is_spark"))
    a = apps.select(F.lit(False).alias("is_pod"),
                    F.upper(F.coalesce(F.col(state), F.lit(""))).alias("s"),
                    F.lit(False).alias("is_spark"))
    both = p.unionByName(a)
    pod, app = F.col("is_pod"), ~F.col("is_pod")
    total_pods = F.count_if(pod)
    spark_pods = F.count_if(pod & F.col("is_spark"))
    return both.agg(
        total_pods.alias("total_pods"),
        F.count_if(pod & (F.col("s") == "running")).alias("running_pods"),
        F.count_if(app & (F.col("s") == "RUNNING")).alias("active_apps"),
        (F.count_if(pod & (F.col("s") == "failed"))
         + F.count_if(app & (F.col("s") == "FAILED"))).alias("failed"),
        spark_pods.alias("spark_pods"),
        (total_pods - spark_pods).alias("infra_pods"),
        F.count_if(app).alias("total_apps"),
    )


def rollup_totals(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column],
                  unread: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Sums per key combination plus subtotal and grand-total rows
    (``ROLLUP``); ``gid`` is ``grouping_id`` (0 = detail row).

    Sums decompose, so the rows are first summed per full key (partial
    aggregation, each measure computed once per input row) and only those
    group rows go through the rollup's Expand, instead of every input row
    once per grouping level.

    A measure that is NULL is not summed. ``unread`` maps names of further
    columns to (measure, source column): beside the totals, how many source
    values that are there gave no measure (a unit that is not known)."""
    unread = dict(unread or {})
    lost = {name: F.when(F.col(source).isNotNull() & measures[measure].isNull(), 1).otherwise(0).cast("bigint")
            for name, (measure, source) in unread.items()}
    sums = [*measures, *unread]
    measured = df.select(*keys, *[m.alias(name) for name, m in (dict(measures) | lost).items()])
    detail = measured.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])
    return (detail.rollup(*keys)
            .agg(*[F.sum(name).alias(name) for name in sums],
                 F.grouping_id().alias("gid")))
