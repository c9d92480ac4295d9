"""NULL keys and values, map columns, sums beyond BIGINT, hot keys, and the
working folder."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewater.functions import rewrite_links
from tidewater.operators import (agg_by_map, delete_by_key, exact_sum, insert_if_absent, latest_by_key,
                                 one_pass_stats, range_join, reconcile, tail_n_per_key, upsert_by_key)
from tidewater.operators.quality import tag_rejects
from tidewater.session import checkpoint_root, get_spark


def keyed(spark, rows):
    return spark.createDataFrame(rows, "key string, v int, labels map<string,string>")


def values(df):
    return sorted(((r.key, r.v, str(r.labels)) for r in df.collect()), key=str)


def test_records_with_maps(spark):
    rows = [("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), ("b", 1, None), ("a", 2, {"x": "0"}), (None, 5, {}), (None, 6, {})]
    assert values(latest_by_key(keyed(spark, rows), "key", ["v"])) == values(keyed(spark, [
        ("a", 2, {"x": "2"}), ("b", 1, None), (None, 6, {})]))


def test_merges_keep_rows_without_a_key(spark):
    target = keyed(spark, [("a", 1, {"x": "1"}), ("b", 2, None), (None, 3, {}), ("", 4, {})])
    new = keyed(spark, [("b", 9, {"y": "1"}), ("b", 8, {}), ("c", 7, {}), (None, 6, {}), (None, 6, {}), ("", 5, {})])
    assert values(upsert_by_key(target, new, "key", ["v"])) == values(keyed(spark, [
        ("a", 1, {"x": "1"}), ("b", 9, {"y": "1"}), ("c", 7, {}), (None, 3, {}), ("", 4, {}), (None, 6, {}), (None, 6, {}), ("", 5, {})]))
    assert values(insert_if_absent(target, new, "key", ["v"])) == values(keyed(spark, [
        ("a", 1, {"x": "1"}), ("b", 2, None), ("c", 7, {}), (None, 3, {}), ("", 4, {}), (None, 6, {}), (None, 6, {}), ("", 5, {})]))
    assert values(delete_by_key(target, keyed(spark, [("a", 0, {}), (None, 0, {}), ("", 0, {})]), "key")) == values(
        keyed(spark, [("b", 2, None), (None, 3, {}), ("", 4, {})]))


def test_reconcile_passes_each_row_without_a_key(spark):
    desired = spark.createDataFrame([("a",), (None,)], "key string")
    actual = spark.createDataFrame([(None,), (None,), ("",), ("b",), ("b",)], "key string")
    got = sorted((str(r.key), r.action) for r in reconcile(desired, actual, "key").collect())
    assert got == sorted([("a", "create"), ("b", "delete"), ("None", "keep"), ("None", "keep"), ("", "keep")])


def test_sums_beyond_bigint(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([(1, big)] * 5 + [(1, -7), (2, None), (3, -big), (3, -big), (4, -(2**63))], "k int, x long")
    got = {r.k: r.sum_x for r in agg_by_map(df, ["k"], {"x": "sum"}).collect()}
    assert {k: None if v is None else int(v) for k, v in got.items()} == {1: 5 * big - 7, 2: None, 3: -2 * big, 4: -(2**63)}
    assert int(one_pass_stats(df.filter("k = 1"), "x").first().total) == 5 * big - 7
    assert df.filter("k = 9").agg(exact_sum("x")).first()[0] is None


def test_tail_of_a_hot_key_reads_n_rows_of_each_part(spark):
    df = spark.range(0, 20_000, 1, 40).select((F.col("id") % 50 > 30).cast("int").alias("k"), "id")
    out = tail_n_per_key(df, "k", ["id"], 200, salts=4)
    want = {k: sorted(i for i in range(20_000) if (i % 50 > 30) == k)[-200:] for k in (0, 1)}
    rows = out.collect()
    for k in (0, 1):
        assert sorted(r.id for r in rows if r.k == k) == want[k]
        assert {r.recency: r.id for r in rows if r.k == k} == {n + 1: i for n, i in enumerate(reversed(want[k]))}
    # what reaches the final window of a key: the first level's rows
    from pyspark.sql import Window
    parted = df.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(4)))
    first = parted.withColumn("n", F.row_number().over(Window.partitionBy("k", "p").orderBy(F.desc("id")))).filter("n <= 200")
    assert max(r[0] for r in first.groupBy("k").count().select("count").collect()) <= 4 * 200


def test_range_join_like_all_pairs(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    points = [(i, at(i * 7.5)) for i in range(200)] + [(900, None)]
    spans = [(i, at(i * 31), at(i * 31 + [0, 5, 60, 700][i % 4])) for i in range(40)] + [(99, None, at(5)), (98, at(9), at(3))]
    p = spark.createDataFrame(points, "p int, ts timestamp_ntz")
    s = spark.createDataFrame(spans, "s int, a timestamp_ntz, b timestamp_ntz")
    got = sorted((r.p, r.s) for r in range_join(p, s, "ts", "a", "b", 60).collect())
    want = sorted((i, j) for i, x in points for j, a, b in spans if x and a and a <= x < b)
    assert got == want and want


def test_links_without_a_content_type(spark):
    df = spark.createDataFrame([('<a href="/x">', None), ('<a href="/x">', "text/html"), ('<a href="/x">', "image/png")], "h string, c string")
    assert [r[0] for r in df.select(rewrite_links("h", "/p/", "c")).collect()] == ['<a href="/p/x">', '<a href="/p/x">', '<a href="/x">']


def test_nan_is_a_bad_value(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, "view", float("nan"), "{}"), (2, dt.datetime(2024, 1, 1), 1, "view", 0.0, "{}")],
                               "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert {r.event_id: r.reject_reason for r in tag_rejects(df).collect()} == {1: "bad_value", 2: None}


def test_no_private_folder_on_a_cluster():
    def session(master):
        conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=conf, sparkContext=context)

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_root(session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert checkpoint_root(session(master))


def test_a_running_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert get_spark("again").conf.get("spark.sql.adaptive.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_tables_are_dropped(spark):
    from tidewater.plans import QUERIES
    names = lambda: {t.name for t in spark.catalog.listTables()}
    before = names()
    for q in ("catalog_roundtrip", "sql_ctas"):
        assert QUERIES[q](spark, "/root/testdata/sf0.001").count() > 0
    assert names() == before
