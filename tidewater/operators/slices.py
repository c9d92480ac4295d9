"""Range slices: rows sorted by key and order, cut into contiguous parts that
no hot key can fill.

``place`` range-partitions and sorts the rows and writes them once to the
shared folder with their slice and their position in it: range bounds are
sampled per exchange, so two separately planned sorts could cut the rows
differently, and a lost executor must not cut them anew. What crosses a slice
boundary is then carried by small tables with a row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.names import unused_names
from tidewater.session import checkpoint_root


def place(df: DataFrame, sort_cols: Sequence[Column], slice_col: str, pos_col: str,
          partitions: int | None = None) -> DataFrame:
    """``df`` with the number of its slice and its position there, checkpointed."""
    ranged = df.repartitionByRange(partitions, *sort_cols) if partitions else df.repartitionByRange(*sort_cols)
    checkpoint_root(df.sparkSession)
    return (ranged.sortWithinPartitions(*sort_cols)
            .withColumn(slice_col, F.spark_partition_id())
            .withColumn(pos_col, F.monotonically_increasing_id())
            .checkpoint())


def asof_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], left_time: str, right_time: str,
              how: str = "left", partitions: int | None = None) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of the same key at
    or before its time.

    ``key`` names columns of both sides; the other columns of the two sides
    must have different names. ``how="left"`` keeps rows without a partner
    (NULLs), ``"inner"`` drops them. Of several right rows of one key and time
    the greatest by the other columns counts. NULL keys and NULL times match
    nothing, on either side. Repeated left rows stay, each with its partner.

    Both sides are sorted together by (key, time) in range slices; inside a
    slice the last right row is carried forward by a window over one (slice,
    key), and a key that goes on in later slices gets the last right row of
    the slices before from a table of one row per (key, slice). So a hot key
    is as many slices as it needs, and no side is multiplied.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how}")
    extra = [c for c in right.columns if c not in keys]
    shared = {c.lower() for c in left.columns} & {c.lower() for c in extra}
    if shared:
        raise ValueError(f"both sides have columns {sorted(shared)}: rename them first")
    row, match, at, kind, spread, part, pos, last = unused_names(
        "_row _match _at _kind _spread _slice _pos _last", left, right)
    usable = F.lit(True)
    for c in [*keys, right_time]:
        usable = usable & F.col(c).isNotNull()
    # Imported here: relations imports nothing from this module.
    from tidewater.operators.relations import latest_by_key
    known = latest_by_key(right.filter(usable).select(*keys, *extra), [*keys, right_time], [])
    rows = known.select(*keys, F.col(right_time).alias(at), F.lit(0).alias(kind), F.lit(0).cast("bigint").alias(spread),
                        F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias(row), F.struct(*extra).alias(match))
    # A hash of the row as the last sort column: rows of one time (or without
    # one) are cut over slices as well.
    asked = left.select(*keys, F.col(left_time).alias(at), F.lit(1).alias(kind), F.xxhash64(*left.columns).alias(spread),
                        F.struct(*left.columns).alias(row), F.lit(None).cast(rows.schema[match].dataType).alias(match))
    order = [F.col(c).asc_nulls_first() for c in [*keys, at, kind, spread]]
    placed = place(rows.unionByName(asked), order, part, pos, partitions)

    inside = Window.partitionBy(part, *keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = placed.withColumn(last, F.last(match, ignorenulls=True).over(inside)).filter(F.col(kind) == 1)
    ends = placed.groupBy(part, *keys).agg(F.max_by(match, F.when(F.col(kind) == 0, F.col(pos))).alias(match))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = unused_names(" ".join(f"_k{i}" for i in range(len(keys))), left, right)
    came = unused_names("_came _part", left, right)
    # Only a key that a slice shares with an earlier one has such a row: one per
    # slice at most, so the table is bounded by the number of slices.
    handed = (ends.withColumn(came[0], F.last(match, ignorenulls=True).over(before)).filter(F.col(came[0]).isNotNull())
              .select(F.col(part).alias(came[1]), F.col(came[0]), *[F.col(k).alias(n) for k, n in zip(keys, names)]))
    same = F.col(part) == F.col(came[1])
    for k, n in zip(keys, names):
        same = same & (F.col(k) == F.col(n))
    joined = carried.join(F.broadcast(handed), same, "left").select(row, F.coalesce(last, came[0]).alias(match), at)
    # A row without a time comes before every right row of its slice, but not
    # of none: a carried row must not reach it.
    partner = F.when(F.col(at).isNotNull(), F.col(match))
    out = joined.select(row, partner.alias(match))
    if how == "inner":
        out = out.filter(F.col(match).isNotNull())
    return out.select(f"{row}.*", *[F.col(match)[c].alias(c) for c in extra])


def quantiles_by_key(df: DataFrame, key: str | Sequence[str], value: str, qs: Sequence[float],
                     q_col: str = "q", value_col: str = "value", partitions: int | None = None) -> DataFrame:
    """Exact discrete quantiles: for every key and every q the smallest value
    of which at least a share q of the key's non-NULL values is no greater
    (``quantile_disc``). Keys without a value give no row; a NULL key is a key
    like any other. NaN is the greatest value, as everywhere in Spark.

    Equal values collapse first (a partial aggregate). The distinct values are
    cut into range slices and counted per (key, slice); running sums over
    these counts find the one slice that holds a rank, and only slices that
    hold one are looked into. No task sees more of a key than a slice of it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    v, c, part, pos, n, below, total, rank, upto = unused_names("_v _c _slice _pos _n _below _total _rank _upto", df.select(*keys))
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles are between 0 and 1")
    groups = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias(v)).agg(F.count(F.lit(1)).alias(c)))
    placed = place(groups, [F.col(x).asc_nulls_first() for x in [*keys, v]], part, pos, partitions)
    counts = placed.groupBy(*keys, part).agg(F.sum(c).alias(n))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    placed_counts = counts.select(*keys, part, n, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(below),
                                  F.sum(n).over(Window.partitionBy(*keys)).alias(total))
    wanted = F.array(*[F.struct(F.lit(float(q)).alias(q_col), F.greatest(
        F.ceil(F.col(total) * F.lit(float(q))), F.lit(1)).cast("bigint").alias(rank)) for q in qs])
    ranks = (placed_counts.withColumn(rank, F.filter(wanted, lambda w: (w[rank] > F.col(below)) & (w[rank] <= F.col(below) + F.col(n))))
             .filter(F.size(rank) > 0).select(*[F.col(k).alias(f"{part}{i}") for i, k in enumerate(keys)],
                                              F.col(part).alias(f"{part}_"), F.col(below), F.col(rank)))
    same = F.col(part) == F.col(f"{part}_")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{part}{i}"))
    inside = Window.partitionBy(part, *keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = (placed.join(ranks, same).withColumn(upto, F.col(below) + F.sum(c).over(inside))
              .withColumn(rank, F.filter(rank, lambda w: (w[rank] <= F.col(upto)) & (w[rank] > F.col(upto) - F.col(c)))))
    return (chosen.select(*keys, F.col(v), F.explode(rank).alias(rank))
            .select(*keys, F.col(rank)[q_col].alias(q_col), F.col(v).alias(value_col)))
