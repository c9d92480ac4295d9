import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import (dependent_rows, insert_if_absent, latest_by_key, reconcile,
                                 split_by_class, stale_rows, tail_n_per_key, union_parts,
                                 upsert_by_key)


def test_log_lines_tail(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("p1", i, t0 + dt.timedelta(seconds=i)) for i in range(150)] + \
           [("p2", i, t0 + dt.timedelta(seconds=i)) for i in range(450)]
    df = spark.createDataFrame(rows, "pod string, line int, ts timestamp_ntz")
    out = tail_n_per_key(df, "pod", ["ts", "line"], 200)
    counts = {r.pod: r.n for r in out.groupBy("pod").agg(F.count("*").alias("n")).collect()}
    assert counts == {"p1": 150, "p2": 200}  # a pod without lines yields no rows
    kept = [r.line for r in out.filter("pod = 'p2'").orderBy("ts").collect()]
    assert kept == list(range(250, 450))  # newest kept, shown oldest first


def test_tail_plan_limits_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = tail_n_per_key(df, "k", ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_reconcile_fixture(spark):
    desired = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "key string")
    actual = spark.createDataFrame([("k2",), ("k3",), (None,), ("",)], "key string")
    out = sorted((str(r.key), r.action) for r in reconcile(desired, actual, "key").collect())
    assert out == sorted([("k1", "create"), ("k2", "keep"), ("k3", "delete"),
                          ("None", "keep"), ("", "keep")])


def test_reconcile_twice_is_only_keep(spark):
    desired = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    actual = spark.createDataFrame([("b",), ("d",)], "key string")
    plan = reconcile(desired, actual, "key")
    applied = plan.filter("action IN ('create', 'keep')").select("key")
    again = reconcile(desired, applied, "key")
    assert {r.action for r in again.collect()} == {"keep"}


def test_stale_keeps_null_and_empty(spark):
    actual = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("", 4)], "key string, v int")
    desired = spark.createDataFrame([("a",)], "key string")
    assert [r.v for r in stale_rows(actual, desired, "key").collect()] == [2]


def test_dependent_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "key string, v int")
    parents = spark.createDataFrame([("a",), ("a",)], "key string")
    assert sorted(r.v for r in dependent_rows(rows, parents, "key").collect()) == [1, 3]


def test_insert_if_absent_idempotent(spark):
    target = spark.createDataFrame([("a", 1)], "key string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 2), ("c", 3)], "key string, v int")
    once = insert_if_absent(target, new, "key")
    twice = insert_if_absent(once, new, "key")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert sorted((r.key, r.v) for r in once.collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_upsert(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    updates = spark.createDataFrame([("b", 20), ("c", 3)], "key string, v int")
    out = sorted((r.key, r.v) for r in upsert_by_key(target, updates, "key").collect())
    assert out == [("a", 1), ("b", 20), ("c", 3)]


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")],
                               "k string, t int, payload string")
    out = sorted(tuple(r) for r in latest_by_key(df, "k", ["t"]).collect())
    assert out == [("a", 3, "y"), ("b", 2, "z")]


def test_parts_add_up(spark, sf_small):
    from tidewater.plans.batch import q_classify_by_key
    c = q_classify_by_key(spark, sf_small)
    parts = split_by_class(c, "class", ["spark", "infra"])
    assert sum(p.count() for p in parts) == c.count()
    assert union_parts(parts).count() == c.count()


def test_order_parts_single_pass_equals_union(spark, sf_small):
    from tidewater.operators import order_parts
    from tidewater.plans.batch import q_classify_by_key
    c = q_classify_by_key(spark, sf_small)
    tagged = order_parts(c, "class", ["spark", "infra"])
    unioned = union_parts(split_by_class(c, "class", ["spark", "infra"]))
    assert sorted(tagged.drop("part").collect()) == sorted(unioned.collect())
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
