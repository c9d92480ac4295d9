"""Mergeable sketches: distinct counts and quantiles of parts of a table that
are stored once and united later, without reading the rows again.

A HyperLogLog sketch of ``lg_k`` bits has a relative standard error of
1.04 / sqrt(2 ** lg_k) (0.8 % for 14), a KLL sketch of size k a rank error of
about 2.3 / k ** 0.9 (0.5 % for 800), whatever the number of rows; both are a
few kilobytes. United sketches have the error of one over all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.names import unused_name

#: Sizes with the errors above.
LG_K, KLL_K = 14, 800


def sketch_rows(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], quantiles: Mapping[str, str],
                lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """One row per key tuple with a sketch column for every entry: ``distinct``
    maps names to columns whose distinct values are counted (HyperLogLog),
    ``quantiles`` to numeric columns (KLL). NULLs are left out, a group of
    only NULLs has an empty sketch. Sketches are filled in each task before
    the shuffle, so a hot key sends one sketch per task."""
    aggs: list[Column] = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(name) for name, c in distinct.items()]
    aggs += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(kll_k)).alias(name) for name, c in quantiles.items()]
    return df.groupBy(*keys).agg(*aggs)


def unite_sketches(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str]) -> DataFrame:
    """Sketches of coarser keys (a subset of the stored ones, or none) from
    stored sketches."""
    aggs = [F.hll_union_agg(name).alias(name) for name in distinct]
    aggs += [F.kll_merge_agg_double(name).alias(name) for name in quantiles]
    return sketches.groupBy(*keys).agg(*aggs)


def read_sketches(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str],
                  qs: Sequence[float]) -> DataFrame:
    """Keys, the estimated distinct count of each ``distinct`` sketch, and an
    array with the estimated value at every rank of ``qs`` (ascending) of each
    ``quantiles`` sketch (NULL for an empty one)."""
    ranks = F.array(*[F.lit(float(q)) for q in qs])
    cols = [F.hll_sketch_estimate(name).alias(name) for name in distinct]
    cols += [F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_quantile_double(name, ranks)).alias(name) for name in quantiles]
    return sketches.select(*keys, *cols)


def rank_errors(df: DataFrame, estimates: DataFrame, key: str, value: str, name: str, qs: Sequence[float]) -> DataFrame:
    """key, q, estimate, rank_error: how far the share of a key's values below
    (or equal to) each estimate is from q, counted over all rows. 0 where q
    lies between the two shares."""
    below, upto, n, est, joined = (unused_name(x, df, estimates) for x in ("_below", "_upto", "_n", "_est", "_joined"))
    wide = estimates.select(F.col(key).alias(joined), F.col(name).alias(est))
    counted = (df.filter(F.col(value).isNotNull()).join(wide, F.col(key).eqNullSafe(F.col(joined)))
               .groupBy(key, est).agg(F.count(F.lit(1)).alias(n),
                                      *[F.count_if(F.col(value) < F.col(est)[i]).alias(f"{below}{i}") for i in range(len(qs))],
                                      *[F.count_if(F.col(value) <= F.col(est)[i]).alias(f"{upto}{i}") for i in range(len(qs))]))
    rows = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(est)[i].alias("estimate"), F.greatest(
        F.col(f"{below}{i}") / F.col(n) - q, F.lit(float(q)) - F.col(f"{upto}{i}") / F.col(n), F.lit(0.0)).alias("rank_error"))
        for i, q in enumerate(qs)])
    return counted.select(key, F.inline(rows))
