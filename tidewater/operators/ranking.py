"""Ranking within a key that stays balanced when one key holds a large share
of the rows.

``Window.partitionBy(key)`` sends every row of a key to one task, so a key
with a third of the table is sorted by a single task. Here the rows are
range-partitioned on (key, order...) instead: Spark samples the bounds, so a
hot key is split over many tasks, each holding a contiguous slice of that
key's order. Each row's position inside its slice comes from the sorted
partition; the slices of one key are stitched together by a small aggregate
(one row per key and partition) and a running sum over it.

The placed rows are checkpointed once in the shared folder: the range bounds
are sampled per exchange, so two separately planned reads of the same range
partitioning could cut the data differently. One stored copy keeps positions
consistent and cuts the lineage (a lost executor does not re-run the sort).
With ``spark.cleaner.referenceTracking.cleanCheckpoints=true`` Spark removes
the copy when the result is no longer referenced.

Every key takes this one path, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import checkpoint_root


def _sort_cols(key: str, order: Sequence[str], ascending: Sequence[bool]) -> list[Column]:
    cols = [F.col(key).asc_nulls_first()]
    for c, asc in zip(order, ascending):
        cols.append(F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last())
    return cols


def _join_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null-safe equi-join on shared column names, keeping one copy."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c)
                       for c in right.columns])
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, "inner").drop(*[f"_r_{c}" for c in cols])


def _place(df: DataFrame, sort_cols: list[Column], partitions: int | None) -> DataFrame:
    """Range-partition and sort once, tag each row with its partition and
    position, and checkpoint the result."""
    # Without an explicit count, adaptive execution may merge neighbouring
    # range partitions; merged ones are still contiguous ranges, and the
    # partition ids are read inside the one job that writes them.
    ranged = (df.repartitionByRange(partitions, *sort_cols) if partitions
              else df.repartitionByRange(*sort_cols))
    checkpoint_root(df.sparkSession)
    return (ranged
            .sortWithinPartitions(*sort_cols)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_idx", F.monotonically_increasing_id())
            .checkpoint())


def row_number_within_key(df: DataFrame, key: str, order: Sequence[str],
                          ascending: Sequence[bool] | None = None, out: str = "rn",
                          count_col: str | None = None, weight: str | None = None,
                          weight_out: str | None = None, weight_count: str | None = None,
                          partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY key ORDER BY order...)``, 1-based.

    ``order`` must be a total order within a key (end it with a unique
    column). ``count_col`` adds the number of rows of the key. With
    ``weight``, ``weight_out`` is the running sum of that column up to and
    including the row (in the same order), NULL as long as all weights so far
    are NULL, and ``weight_count`` the running number of weights that aren't
    NULL. A NULL key is a key like any other."""
    ascending = list(ascending) if ascending is not None else [True] * len(order)
    placed = _place(df, _sort_cols(key, order, ascending), partitions)
    # One row per (key, partition): where the slice starts, its size, its weight.
    sums = [F.min("_idx").alias("_start"), F.count(F.lit(1)).alias("_n")]
    if weight:
        sums += [F.coalesce(F.sum(weight), F.lit(0)).alias("_w"), F.count(weight).alias("_k")]
    slices = placed.groupBy(key, "_pid").agg(*sums)
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)

    def upto(c: str) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    keep = [F.col(key), F.col("_pid"), F.col("_start"), upto("_n").alias("_offset")]
    if weight:
        keep += [upto("_w").alias("_woffset"), upto("_k").alias("_koffset")]
    if count_col:
        keep.append(F.sum("_n").over(Window.partitionBy(key)).alias(count_col))
    joined = _join_on(placed, slices.select(*keep), [key, "_pid"])
    out_df = joined.withColumn(out, F.col("_offset") + F.col("_idx") - F.col("_start") + 1)
    if weight:
        # inside the slice: rows of one (key, partition) only
        inside = Window.partitionBy(key, "_pid").orderBy("_idx").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        out_df = (out_df.withColumn("_kin", F.col("_koffset") + F.count(weight).over(inside))
                  .withColumn("_win", F.col("_woffset") + F.coalesce(F.sum(weight).over(inside), F.lit(0))))
        if weight_out:
            out_df = out_df.withColumn(weight_out, F.when(F.col("_kin") > 0, F.col("_win")))
        if weight_count:
            out_df = out_df.withColumn(weight_count, F.col("_kin"))
    return out_df.drop("_pid", "_idx", "_start", "_offset", "_woffset", "_koffset", "_kin", "_win")


def rank_within_key(df: DataFrame, key: str, order: Sequence[str],
                    ascending: Sequence[bool] | None = None, rank_col: str = "rank",
                    dense_col: str | None = None) -> DataFrame:
    """``rank()`` (and optionally ``dense_rank()``) by ``order`` within key.

    Ties are collapsed first: one row per (key, order value) with its row
    count (a partial aggregate). Over those groups, in order, dense_rank is
    the group's row number and rank is 1 + the rows of all earlier groups.
    The groups get their numbers from ``row_number_within_key`` and are
    joined back to the rows on (key, order value); a tie group that holds a
    large share of the rows is the streamed side of that join, which adaptive
    execution splits."""
    # Within a key all rows have the same key: it orders nothing.
    picked = [(c, a) for c, a in zip(order, ascending or [True] * len(order)) if c != key]
    order, ascending = [c for c, _ in picked], [a for _, a in picked]
    if not order:
        return df.withColumns({c: F.lit(1).cast("bigint") for c in (rank_col, dense_col) if c})
    tie = [key, *order]
    groups = df.groupBy(*tie).agg(F.count(F.lit(1)).alias("_c"))
    numbered = row_number_within_key(groups, key, list(order), ascending, out="_g",
                                     weight="_c", weight_out="_upto")
    ranks = numbered.select(*tie, (F.col("_upto") - F.col("_c") + 1).alias(rank_col),
                            *([F.col("_g").alias(dense_col)] if dense_col else []))
    return _join_on(df, ranks, tie)


def ntile_from(rn, cnt, buckets: int) -> Column:
    """``ntile(buckets)`` from a 1-based row number and the key's row count:
    the first ``cnt % buckets`` buckets hold one row more than the others."""
    rn = F.col(rn) if isinstance(rn, str) else rn
    cnt = F.col(cnt) if isinstance(cnt, str) else cnt
    base = F.floor(cnt / buckets)
    rem = cnt - base * buckets
    big = rem * (base + 1)
    # The second branch only runs when base > 0; try_divide keeps eager
    # evaluation of it from failing when base = 0.
    return (F.when(rn <= big, F.floor(F.try_divide(rn - 1, base + 1)) + 1)
            .otherwise(rem + F.floor(F.try_divide(rn - 1 - big, base)) + 1)).cast("bigint")


def ntile_within_key(df: DataFrame, key: str, order: Sequence[str], buckets: int,
                     ascending: Sequence[bool] | None = None,
                     out: str = "ntile") -> DataFrame:
    """``ntile(buckets)`` by a total ``order`` within key."""
    numbered = row_number_within_key(df, key, order, ascending, out="_rn", count_col="_cnt")
    return numbered.withColumn(out, ntile_from("_rn", "_cnt", buckets)).drop("_rn", "_cnt")
