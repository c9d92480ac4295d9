"""Keyed relations: classification, last-N, reconciliation, upsert.

Skew: every operator here first reduces each side to one row per key with an
aggregate (partial aggregation happens before the shuffle), or uses the
partial ``WindowGroupLimit`` that Spark inserts before the exchange, so a key
holding a large share of the rows never sends all of them to one task.
Join strategy (broadcast vs sort-merge) is left to adaptive execution, which
uses the measured size of the shuffled side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, TimestampNTZType

from tidewater.functions.strings import valid_key
from tidewater.operators.names import unused_name, unused_names


def _valid(df: DataFrame, key: str) -> Column:
    """Usable key: not NULL, and not empty when the key is text."""
    return valid_key(key, isinstance(df.schema[key].dataType, StringType))


def _cols(cs) -> list[Column]:
    if isinstance(cs, (str, Column)):
        cs = [cs]
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def split_by_class(df: DataFrame, class_col: str, classes: Sequence[str]) -> list[DataFrame]:
    """One DataFrame per class value: a filter each, so each part that is
    consumed scans the input; ``order_parts`` re-unites parts in one pass."""
    return [df.filter(F.col(class_col) == F.lit(c)) for c in classes]


def order_parts(df: DataFrame, class_col: str, classes: Sequence[str],
                pos_col: str = "part") -> DataFrame:
    """The re-union of the parts of ONE input in the given class order, in a
    single pass: each row keeps its class and gets its part position (0 for
    the first class, ...); rows of unlisted classes are dropped, as a union of
    the listed parts would drop them. Unlike unioning filters of the same
    input, the input is scanned once."""
    positions = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    pos = F.try_element_at(positions, F.col(class_col))
    return df.withColumn(pos_col, pos).filter(F.col(pos_col).isNotNull())


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate parts by column name, in the given order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tail_n_per_key(df: DataFrame, key, order, n: int, rank_col: str = "recency",
                   salts: int = 16) -> DataFrame:
    """The last ``n`` rows per key by ``order`` (newest has ``recency`` 1).

    In two levels: the rows of a key are dealt by a hash of their order values
    into ``salts`` parts, each part keeps its last ``n``, and the last ``n``
    of those are the result. Both ``row_number() <= n`` are planned with a
    partial WindowGroupLimit before the shuffle; the final task of a key reads
    at most ``n * salts`` rows however many map tasks there were."""
    newest = [c.desc() for c in _cols(order)]
    part, level = unused_names("_part _level", df)
    parted = df.withColumn(part, F.pmod(F.xxhash64(*_cols(order)), F.lit(salts)))
    first = Window.partitionBy(*_cols(key), part).orderBy(*newest)
    last = Window.partitionBy(*_cols(key)).orderBy(*newest)
    return (parted.withColumn(level, F.row_number().over(first)).filter(F.col(level) <= n)
            .drop(part, level)
            .withColumn(rank_col, F.row_number().over(last)).filter(F.col(rank_col) <= n))


def _has_map(t: DataType) -> bool:
    if isinstance(t, MapType):
        return True
    if isinstance(t, ArrayType):
        return _has_map(t.elementType)
    return isinstance(t, StructType) and any(_has_map(f.dataType) for f in t.fields)


def latest_by_key(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    """One row per key (one column or several): the row with the greatest
    ``order`` tuple; equal tuples are decided by the other columns, maps by
    their JSON text. An aggregate that works partially per map task, so hot
    keys collapse before the shuffle. A NULL key is a key like any other."""
    keys = [key] if isinstance(key, str) else list(key)
    order = list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    maps = {c for c in order + rest if _has_map(df.schema[c].dataType)}
    row = F.struct(*[F.col(c) for c in order + rest]) if order + rest else F.struct(*[F.col(c) for c in keys])
    whole = unused_name("_best", df)
    if maps:
        by = F.struct(*[F.to_json(F.struct(c)).alias(c) if c in maps else F.col(c) for c in order + rest])
        best = F.max_by(row, by).alias(whole)
    else:
        best = F.max(row).alias(whole)
    return (df.groupBy(*keys).agg(best)
            .select(*keys, *[F.col(whole)[c].alias(c) for c in order + rest])
            .select(*df.columns))


def _distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).filter(_valid(df, key)).distinct()


def stale_rows(actual: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """Rows of ``actual`` whose key has no ``desired`` row. Rows with a NULL
    or empty key are never stale."""
    return actual.filter(_valid(actual, key)).join(_distinct_keys(desired, key), key, "left_anti")


def dependent_rows(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` whose key has a row in ``parents`` (semi-join)."""
    return rows.join(_distinct_keys(parents, key), key, "left_semi")


def _one_per_key(df: DataFrame, key: str, order: Sequence[str] | None) -> DataFrame:
    """Deterministic de-duplication: the greatest ``order`` (else the greatest
    whole row) per key. Rows without a usable key all stay."""
    lone = F.when(~F.coalesce(_valid(df, key), F.lit(False)), F.monotonically_increasing_id())
    by = list(order) if order else [c for c in df.columns if c != key]
    own = unused_name("_lone", df)
    return latest_by_key(df.withColumn(own, lone), [key, own], by).drop(own)


def _merge(target: DataFrame, new: DataFrame, key: str, order, prefer_new: bool) -> DataFrame:
    """Full outer join of target rows and one new row per key; each input is
    read once. Rows without a usable key match nothing and all stay: a second
    join column spreads them, where a NULL key alone would send all of them
    to one task (an outer join's tasks are not split at run time)."""
    cols = target.columns
    fresh = _one_per_key(new.select(*cols), key, order)
    t, tk, ts, f, fk, fs, row = unused_names("_t _tk _ts _f _fk _fs _row", target)

    def side(df: DataFrame, whole: str, k: str, spread: str) -> DataFrame:
        usable = F.coalesce(_valid(df, key), F.lit(False))
        # Fixed by the row and its partition, so a repeated task deals alike.
        lone = F.xxhash64(F.xxhash64(*[c for c in cols if not _has_map(df.schema[c].dataType)]), F.spark_partition_id())
        return df.select(F.struct(*cols).alias(whole), F.when(usable, F.col(key)).alias(k),
                         F.when(usable, F.lit(0).cast("bigint")).otherwise(lone).alias(spread))

    both = side(target, t, tk, ts).join(side(fresh, f, fk, fs), (F.col(tk) == F.col(fk)) & (F.col(ts) == F.col(fs)), "full_outer")
    best = F.coalesce(f, t) if prefer_new else F.coalesce(t, f)
    return both.select(best.alias(row)).select(f"{row}.*")


def insert_if_absent(target: DataFrame, new: DataFrame, key: str,
                     order: Sequence[str] | None = None) -> DataFrame:
    """Target plus the new rows whose key is not in the target yet (one row
    per new key). Running it twice adds nothing the second time, except that
    new rows with a NULL or empty key can't be matched and are added."""
    return _merge(target, new, key, order, prefer_new=False)


def upsert_by_key(target: DataFrame, updates: DataFrame, key: str,
                  order: Sequence[str] | None = None) -> DataFrame:
    """Replace target rows that have an update, add new keys: target rows
    without an update, plus one update row per key. ``target`` holds one row
    per key; rows with a NULL or empty key, on either side, all stay."""
    return _merge(target, updates, key, order, prefer_new=True)


#: Ratio of neighbouring bucket widths of ``range_join``.
WIDTH_STEP = 16


def _epoch_seconds(df: DataFrame, c: str) -> Column:
    """Whole seconds of a time column since 1970; a time without zone counts
    as UTC, whose order has no gaps or folds."""
    if isinstance(df.schema[c].dataType, TimestampNTZType):
        day = F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
        return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.unix_seconds(F.col(c).cast("timestamp"))


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str,
               bucket_seconds: int) -> DataFrame:
    """Rows of ``points`` whose time lies in ``[start, end)`` of a row of
    ``spans``, for conditions without an equal key.

    Time is cut into buckets of several widths: ``bucket_seconds``, 16 times
    that, 256 times, and so on. A span goes to the buckets it touches of the
    smallest width that is no shorter than the span, two at most, so a span of
    a minute and one with an open end (year 9999) cost the same; a point goes
    to its one bucket of every width that some span uses (ten widths reach
    from ten minutes over 8,000 years). Both meet by an equi-join on (width,
    bucket), which adaptive execution splits where a bucket is hot. A pair
    meets in the point's bucket of the span's width only, so none is found
    twice. Choose ``bucket_seconds`` about as long as common spans. NULL
    times match nothing."""
    width, bucket, w, b, first, last, length = unused_names("_width _bucket _w _b _first _last _length", points, spans)
    whole = (spans.filter(F.col(start) < F.col(end))
             .withColumns({first: _epoch_seconds(spans, start), last: _epoch_seconds(spans, end)})
             .withColumn(length, F.col(last) - F.col(first)))
    # The least k with bucket_seconds * 16^k >= length, by comparison alone.
    steps = [bucket_seconds * WIDTH_STEP ** k for k in range(16) if bucket_seconds * WIDTH_STEP ** k < 2 ** 62]
    size = F.lit(steps[-1]).cast("bigint")
    for step in reversed(steps):
        size = F.when(F.col(length) <= step, F.lit(step).cast("bigint")).otherwise(size)
    sized = whole.withColumn(width, size)
    copied = sized.withColumn(bucket, F.explode(F.sequence(
        F.floor(F.col(first) / F.col(width)).cast("bigint"), F.floor(F.col(last) / F.col(width)).cast("bigint"))))
    # At most as many values as there are widths, read once for all points.
    used = sized.agg(F.collect_set(width)).scalar()
    placed = (points.filter(F.col(point).isNotNull()).withColumn(w, F.explode(used))
              .withColumn(b, F.floor(_epoch_seconds(points, point) / F.col(w)).cast("bigint")))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    return (placed.join(copied, (F.col(w) == F.col(width)) & (F.col(b) == F.col(bucket))).filter(inside)
            .drop(width, bucket, w, b, first, last, length))


def delete_by_key(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Target without the rows whose key occurs in ``keys``. NULL and empty
    keys delete nothing, and target rows with such a key stay."""
    return target.join(_distinct_keys(keys, key), key, "left_anti").select(*target.columns)


def reconcile(desired: DataFrame, actual: DataFrame, key: str,
              action_col: str = "action") -> DataFrame:
    """Plan per key: ``create`` (desired only), ``keep`` (both), ``delete``
    (actual only). Both sides are reduced to one row per key first, so the full
    outer join is one-to-one per key. Actual rows with a NULL or empty key
    pass through as ``keep``, each of them; desired rows without a key cannot
    be created and are dropped."""
    d = _distinct_keys(desired, key).select(F.col(key).alias("_dk"))
    usable = F.coalesce(_valid(actual, key), F.lit(False))
    a = (actual.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
         .select(F.col(key).alias("_ak"), usable.alias("_usable"), "_rows"))
    planned = d.join(a, (F.col("_dk") == F.col("_ak")) & F.col("_usable"), "full_outer")
    action = (F.when(F.col("_rows").isNull(), F.lit("create"))
              .when(F.col("_usable") & F.col("_dk").isNull(), F.lit("delete"))
              .otherwise(F.lit("keep")))
    times = F.when(F.col("_usable") | F.col("_rows").isNull(), F.lit(1)).otherwise(F.col("_rows"))
    return (planned.select(F.coalesce("_dk", "_ak").alias(key), action.alias(action_col), times.alias("_times"))
            .withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times").cast("bigint"))))
            .drop("_times", "_n"))
