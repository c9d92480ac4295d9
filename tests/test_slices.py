"""As-of join and exact quantiles by range slices, also with one hot key."""

import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.operators import asof_join, quantiles_by_key

T0 = dt.datetime(2024, 5, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def frames(spark, left, right):
    return (spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(left)], "i int, k string, t timestamp_ntz"),
            spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k string, rt timestamp_ntz, v int"))


def brute_force(left, right):
    out = {}
    for i, (k, t) in enumerate(left):
        known = [(rt, v) for rk, rt, v in right if rk == k and k is not None and rt is not None and t is not None and rt <= t]
        best = max(known, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=None)
        out[i] = (at(best[0]), best[1]) if best else (None, None)
    return out


KEYS = st.sampled_from(["hot", "hot", "hot", "a", "b", None])
TIMES = st.none() | st.integers(0, 30)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(KEYS, TIMES), max_size=30), st.lists(st.tuples(KEYS, TIMES, st.none() | st.integers(0, 9)), max_size=30),
       st.sampled_from([1, 3, 16]))
def test_asof_equals_brute_force(spark, left, right, slices):
    lf, rf = frames(spark, left, right)
    got = {r.i: (r.rt, r.v) for r in asof_join(lf, rf, "k", "t", "rt", partitions=slices).collect()}
    want = brute_force(left, right)
    assert got == want
    inner = {r.i: (r.rt, r.v) for r in asof_join(lf, rf, "k", "t", "rt", how="inner", partitions=slices).collect()}
    assert inner == {i: x for i, x in want.items() if x != (None, None)}


def test_asof_on_a_hot_key(spark):
    """A key with half of the rows: one early right row is carried through
    many slices, and no slice holds the key."""
    rng = random.Random(1)
    left = [("hot" if i % 2 else f"k{i % 50}", rng.randrange(100_000)) for i in range(20_000)]
    right = [("hot", 5, 1), ("hot", 99_000, 2)] + [(f"k{i}", 50_000, i) for i in range(50)]
    lf, rf = frames(spark, left, right)
    df = asof_join(lf, rf, "k", "t", "rt", partitions=16)
    got = {r.i: (r.rt, r.v) for r in df.collect()}
    assert got == brute_force(left, right)
    from tidewater.operators.slices import place
    cut = place(lf, [F.col("k"), F.col("t")], "s", "p", 16)
    sizes = [r["count"] for r in cut.groupBy("s").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16


def test_asof_same_times_and_repeated_rows(spark):
    """Ten thousand left rows of one key and one time, some repeated."""
    left = [("a", 10)] * 10_000 + [("a", None)] * 1000
    lf, rf = frames(spark, left, [("a", 10, 1), ("a", 10, 3), ("a", 10, None), ("a", 11, 9)])
    got = asof_join(lf.drop("i"), rf, "k", "t", "rt", partitions=8).groupBy("t", "v").count().collect()
    assert sorted((r.t is None, r.v, r["count"]) for r in got) == [(False, 3, 10_000), (True, None, 1000)]


def test_asof_clashing_names(spark):
    names = ["_row", "_match", "_at", "_kind", "_spread", "_slice", "_pos", "_last", "_k0", "_came", "_part", "_best"]
    lf, rf = frames(spark, [("a", 5), ("b", 1)], [("a", 4, 7)])
    lf = lf.withColumns({n: F.lit("x") for n in names})
    rf = rf.withColumns({f"_{n}": F.lit(1) for n in names})
    got = asof_join(lf, rf, "k", "t", "rt").collect()
    assert {r.k: r.v for r in got} == {"a": 7, "b": None} and got[0]._slice == "x"
    with pytest.raises(ValueError, match="rename"):
        asof_join(lf, rf.withColumnRenamed("v", "I"), "k", "t", "rt")
    with pytest.raises(ValueError, match="how"):
        asof_join(lf, rf, "k", "t", "rt", how="outer")


def test_asof_several_keys_and_empty_sides(spark):
    lf = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (2, "x", 5)], "a int, b string, t int")
    rf = spark.createDataFrame([(1, "x", 3, "p"), (1, "y", 6, "q")], "a int, b string, rt int, v string")
    got = asof_join(lf, rf, ["a", "b"], "t", "rt")
    assert sorted(((r.a, r.b, r.v) for r in got.collect()), key=str) == [(1, "x", "p"), (1, "y", None), (2, "x", None)]
    assert asof_join(lf, rf.limit(0), ["a", "b"], "t", "rt").count() == 3
    assert asof_join(lf.limit(0), rf, ["a", "b"], "t", "rt").count() == 0


def disc(values, q):
    return sorted(values)[max(math.ceil(len(values) * q), 1) - 1]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(KEYS, st.none() | st.integers(-5, 20)), max_size=60), st.sampled_from([1, 4, 16]))
def test_quantiles_equal_sorting(spark, rows, slices):
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "k string, x int")
    got = {(r.k, r.q): r.value for r in quantiles_by_key(df, "k", "x", qs, partitions=slices).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        values = [x for kk, x in rows if kk == k and x is not None]
        want |= {(k, q): disc(values, q) for q in qs if values}
    assert got == want


def test_quantiles_on_a_hot_key(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 100)) as k", "id * 7919 % 30011 as x", "1 as _v", "2 as _slice")
    rows = {}
    for r in df.collect():
        rows.setdefault(r.k, []).append(r.x)
    got = {(r.k, r.q): r.price for r in quantiles_by_key(df, "k", "x", [0.25, 0.5], value_col="price", partitions=16).collect()}
    assert got == {(k, q): disc(v, q) for k, v in rows.items() for q in (0.25, 0.5)}


def test_quantiles_of_ties_nan_and_wrong_q(spark):
    df = spark.createDataFrame([("a", 1.0)] * 99 + [("a", float("nan"))], "k string, x double")
    got = {r.q: r.value for r in quantiles_by_key(df, "k", "x", [0.5, 0.99]).collect()}
    assert got == {0.5: 1.0, 0.99: 1.0}
    assert math.isnan(quantiles_by_key(df, "k", "x", [1.0]).first().value)
    with pytest.raises(ValueError, match="between"):
        quantiles_by_key(df, "k", "x", [1.1])
