"""Window frames within a key that stay balanced when one key holds a large
share of the rows.

All of them start from ``row_number_within_key`` (range-partitioned slices,
see ``ranking.py``), which gives every row its position ``rn`` within the key
and, optionally, a running sum. Neighbours are then fetched with equi-joins
on (key, rn +- k): every row has its own join key, so even a hot key spreads
evenly over the join's tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ranking import _join_on, row_number_within_key


def neighbours_within_key(numbered: DataFrame, key: str, rn: str,
                          fetch: Sequence[tuple[str, int, str]]) -> DataFrame:
    """For each ``(column, offset, out)``: ``out`` = ``column`` of the row at
    position ``rn + offset`` of the same key (NULL past either end), so
    offset -1 is ``lag`` and +1 is ``lead``.

    The shifted projections are unioned and collapsed to one row per
    (key, rn) (a partial aggregate), then left-joined to the rows."""
    types = dict(numbered.dtypes)
    outs = [o for _, _, o in fetch]
    parts = []
    for col, offset, out in fetch:
        parts.append(numbered.select(
            F.col(key), (F.col(rn) - offset).alias(rn),
            *[(F.col(col) if o == out else F.lit(None).cast(types[c]))
              .alias(o) for c, _, o in fetch]))
    shifted = parts[0]
    for part in parts[1:]:
        shifted = shifted.unionByName(part)
    neighbours = shifted.groupBy(key, rn).agg(*[F.max(o).alias(o) for o in outs])
    return _left_join_on(numbered, neighbours, [key, rn])


def frame_sum(running, count, earlier, earlier_count) -> Column:
    """Sum of the values between two positions from the running sums and the
    running numbers of non-NULL values there: NULL for a frame of only NULLs."""
    inside = F.col(count) - F.coalesce(F.col(earlier_count), F.lit(0))
    return F.when(inside > 0, F.col(running) - F.coalesce(F.col(earlier), F.lit(0)))


def rows_frame_sum(numbered: DataFrame, key: str, rn: str, running: str, count: str,
                   preceding: int, out: str) -> DataFrame:
    """``sum(x) OVER (... ROWS BETWEEN preceding PRECEDING AND CURRENT ROW)``
    from the running sum of x and the running number of its non-NULL values.
    Exact for integer and decimal x (use a decimal cast for money)."""
    back = -(preceding + 1)
    joined = neighbours_within_key(numbered, key, rn, [(running, back, "_earlier"),
                                                       (count, back, "_ecount")])
    return (joined.withColumn(out, frame_sum(running, count, "_earlier", "_ecount"))
            .drop("_earlier", "_ecount"))


def range_count_within_key(df: DataFrame, key: str, ts: str, span: Column,
                           out: str) -> DataFrame:
    """``count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN span
    PRECEDING AND CURRENT ROW)``: rows of the key with ts in [t - span, t],
    peers of t included.

    Equal to C(<= t) - C(< t - span). Distinct (key, ts) groups carry their
    row counts; for each group a probe row at t - span is merged in, sorted
    before data of the same time. One running count over the merged rows
    gives C(<= t) at each data group and C(< t - span) at each probe."""
    groups = df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("_c"))
    data = groups.select(key, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), "_c",
                         F.col(ts).alias("_for"))
    probes = groups.select(key, (F.col(ts) - span).alias("_t"), F.lit(0).alias("_kind"),
                           F.lit(0).cast("bigint").alias("_c"), F.col(ts).alias("_for"))
    merged = data.unionByName(probes)
    counted = row_number_within_key(merged, key, ["_t", "_kind"], out="_pos", weight="_c",
                                    weight_out="_upto")
    upto = counted.filter("_kind = 1").select(key, F.col("_for").alias(ts),
                                              F.col("_upto").alias("_le"))
    before = counted.filter("_kind = 0").select(key, F.col("_for").alias(ts),
                                                F.col("_upto").alias("_lt"))
    per_ts = _join_on(upto, before, [key, ts]).select(
        key, ts, (F.col("_le") - F.col("_lt")).alias(out))
    return _join_on(df, per_ts, [key, ts])


def _left_join_on(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null-safe left equi-join on shared column names, keeping one copy."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c)
                       for c in right.columns])
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, "left").drop(*[f"_r_{c}" for c in cols])
