"""Two ways for one result: keys that fit a task take Spark's own operator,
the few that don't take one that cuts them.

A window over a key sorts the key's rows in one task. That is the cheapest
plan for nearly all keys of nearly all tables, and impossible for a key with a
third of 100 TB. ``by_key_size`` counts the rows per key (a partial aggregate
of the key column alone) and sends each key the way its size asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.names import unused_name

#: Rows of a key that one task sorts and keeps without trouble.
ROWS_PER_TASK = 1_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """The keys with more rows than a task should hold, or None if there are
    none: over ``rows_per_task``, and over a quarter of an even share of all
    rows among the shuffle partitions. So there are at most four per
    partition, whatever the table, and they may be broadcast."""
    n = unused_name("_n", df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    share = (total or 0) / (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = max(rows_per_task, share)
    if most is None or most <= limit:
        return None
    rows = counts.filter(F.col(n) > limit).drop(n).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema)


def by_key_size(df: DataFrame, keys: Sequence[str], plain: Callable[[DataFrame], DataFrame],
                cut: Callable[[DataFrame], DataFrame], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``plain`` of the rows whose key fits a task and ``cut`` of the others;
    both must give the same columns. NULL is a key like any other. Without a
    hot key the plan is ``plain``'s alone."""
    keys = list(keys)
    hot = hot_keys(df, keys, rows_per_task)
    if hot is None:
        return plain(df)
    names = [unused_name(f"_hot{i}", df) for i in range(len(keys))]
    listed = F.broadcast(hot.toDF(*names))
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    cold = plain(df.join(listed, same, "left_anti"))
    return cold.unionByName(cut(df.join(listed, same, "left_semi")))
