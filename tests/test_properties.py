"""Property tests: random inputs against the plain-Python meaning of each
rule. Each example is one small Spark job, so example counts stay low."""

import os.path
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import derive_key, file_extension
from tidewater.operators import insert_if_absent, reconcile, split_explode, stale_rows, word_count

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

name_chars = st.sampled_from(list("ab.-/_xyzPJ") + ["driver", "-driver", ".py", ".jar"])
names = st.lists(name_chars, min_size=0, max_size=8).map("".join)
keys = st.lists(st.sampled_from(["k1", "k2", "k3", "k4", "", None]), max_size=12)


@SETTINGS
@given(st.lists(names, min_size=1, max_size=20))
def test_extension_like_splitext(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "name string")
    got = [r.e for r in df.select(file_extension("name").alias("e")).collect()]
    assert got == [os.path.splitext(v)[1].lower() for v in values]


@SETTINGS
@given(st.lists(st.tuples(names, st.sampled_from([None, "", "sel"])), min_size=1, max_size=20))
def test_derive_key_like_rsplit(spark, rows):
    df = spark.createDataFrame(rows, "name string, sel string")
    got = [r.k for r in df.select(derive_key("sel", "name").alias("k")).collect()]
    assert got == [s or n.rsplit("-driver", 1)[0] for n, s in rows]


@SETTINGS
@given(st.lists(st.text(alphabet=" ,ab\t", max_size=12), min_size=1, max_size=8))
def test_split_like_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = sorted((r.i, r.pos, r.item) for r in split_explode(df, "s", ",", keep=("i",)).collect())
    want = sorted((i, p, x) for i, t in enumerate(texts) for p, x in enumerate(t.split(",")))
    assert got == want


@SETTINGS
@given(st.lists(st.text(alphabet=" \t\n\r\fab", max_size=15), min_size=1, max_size=8))
def test_word_count_like_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.n for r in word_count(df).collect()}
    want = {}
    for t in texts:
        for w in re.split(r"[ \t\n\r\f]+", t):
            if w:
                want[w] = want.get(w, 0) + 1
    assert got == want


@SETTINGS
@given(keys, keys)
def test_reconcile_like_sets(spark, desired, actual):
    d = spark.createDataFrame([(k,) for k in desired], "key string")
    a = spark.createDataFrame([(k,) for k in actual], "key string")
    got = sorted((str(r.key), r.action) for r in reconcile(d, a, "key").collect())
    dv = {k for k in desired if k}
    av = {k for k in actual if k}
    want = [(k, "create") for k in dv - av] + [(k, "keep") for k in dv & av] + \
           [(k, "delete") for k in av - dv] + [(str(k), "keep") for k in actual if not k]
    assert got == sorted(want)
    stale = sorted(r.key for r in stale_rows(a, d, "key").collect())
    assert stale == sorted(k for k in actual if k and k not in dv)


@SETTINGS
@given(keys, keys)
def test_insert_if_absent_like_sets(spark, target, new):
    t = spark.createDataFrame([(k, 0) for k in target], "key string, v int")
    n = spark.createDataFrame([(k, 1) for k in new], "key string, v int")
    out = insert_if_absent(t, n, "key").collect()
    added = sorted(r.key for r in out if r.v == 1 and r.key)
    tv = {k for k in target if k}
    assert added == sorted({k for k in new if k} - tv)
    # rows without a usable key match nothing and all stay
    assert len([r for r in out if r.v == 1 and not r.key]) == len([k for k in new if not k])
    assert len([r for r in out if r.v == 0]) == len(target)


rank_rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]),
                               st.one_of(st.none(), st.integers(0, 4))),
                     min_size=1, max_size=25)


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rank_rows, st.booleans())
def test_ranking_like_window(spark, rows, asc):
    from pyspark.sql import Window
    from tidewater.operators import ntile_from, rank_within_key, row_number_within_key
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)],
                               "id int, k string, v int")
    vo = F.col("v").asc() if asc else F.col("v").desc()
    w_rn = Window.partitionBy("k").orderBy(vo, "id")
    w_rk = Window.partitionBy("k").orderBy(vo)
    want = {r.id: tuple(r)[1:] for r in df.select(
        "id", F.row_number().over(w_rn).cast("long"), F.ntile(3).over(w_rn).cast("long"),
        F.rank().over(w_rk).cast("long"), F.dense_rank().over(w_rk).cast("long")).collect()}
    numbered = row_number_within_key(df, "k", ["v", "id"], [asc, True], out="rn",
                                     count_col="cnt", partitions=4)
    tiled = numbered.withColumn("t3", ntile_from("rn", "cnt", 3))
    ranked = rank_within_key(tiled, "k", ["v"], [asc], rank_col="rk", dense_col="drk")
    got = {r.id: (r.rn, r.t3, r.rk, r.drk) for r in ranked.collect()}
    assert got == want


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", None]), st.integers(0, 6),
                          st.one_of(st.none(), st.integers(-3, 3))), min_size=1, max_size=25))
def test_frames_like_window(spark, rows):
    from pyspark.sql import Window
    from tidewater.operators import (neighbours_within_key, range_count_within_key,
                                     row_number_within_key, rows_frame_sum)
    df = spark.createDataFrame([(i, k, t, x) for i, (k, t, x) in enumerate(rows)],
                               "id int, k string, t long, x long")
    w = Window.partitionBy("k").orderBy("t", "id")
    wr = Window.partitionBy("k").orderBy("t").rangeBetween(-2, Window.currentRow)
    want = {r.id: tuple(r)[1:] for r in df.select(
        "id", F.lag("x").over(w), F.lead("id").over(w),
        F.sum("x").over(w.rowsBetween(-1, Window.currentRow)),
        F.count(F.lit(1)).over(wr)).collect()}
    numbered = row_number_within_key(df, "k", ["t", "id"], out="rn", weight="x",
                                     weight_out="run", weight_count="seen", partitions=4)
    near = neighbours_within_key(numbered, "k", "rn", [("x", -1, "lag"), ("id", 1, "lead")])
    summed = rows_frame_sum(near, "k", "rn", "run", "seen", 1, "s2")
    got_df = range_count_within_key(summed, "k", "t", F.lit(2), "n2")
    got = {r.id: (r.lag, r.lead, r.s2, r.n2, r.run) for r in got_df.collect()}
    running = {r.id: r.s for r in df.select("id", F.sum("x").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("s")).collect()}
    assert got == {i: (*v, running[i]) for i, v in want.items()}


def test_all_null_frame_and_weights(spark):
    from tidewater.operators import row_number_within_key, rows_frame_sum
    df = spark.createDataFrame([(i, "a" if i < 40 else None, None if 11 <= i <= 31 or i >= 40 else i)
                                for i in range(45)], "id int, k string, x long")
    numbered = row_number_within_key(df, "k", ["id"], out="rn", weight="x", weight_out="run",
                                     weight_count="seen", partitions=6)
    got = {r.id: (r.run, r.s3) for r in rows_frame_sum(numbered, "k", "rn", "run", "seen", 2, "s3").collect()}
    run = 0
    for i in range(40):
        run += 0 if 11 <= i <= 31 else i
        frame = [j for j in range(max(0, i - 2), i + 1) if not 11 <= j <= 31]
        assert got[i] == (run, sum(frame) if frame else None)
    assert all(got[i] == (None, None) for i in range(40, 45))


STATUS_WORDS = ["Running", "running", "SUCCEEDED", "Completed", "Pending", "ContainerCreating",
                "Failed", "Error", "Evicted", "", None]


@SETTINGS
@given(st.lists(st.sampled_from(STATUS_WORDS), min_size=1, max_size=20))
def test_status_words_like_dashboard(spark, values):
    from tidewater.functions import STATUS_CLASSES, status_class, status_text
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r.i: (r.t, r.c) for r in df.select(
        "i", status_text("s").alias("t"), status_class("s").alias("c")).collect()}
    for i, v in enumerate(values):
        s = (v or "").lower()
        assert got[i] == (s or "unknown", STATUS_CLASSES.get(s, "unknown"))


label_maps = st.one_of(st.none(), st.dictionaries(
    st.sampled_from(["spark-role", "app", "x", "y"]), st.sampled_from(["", "v1", "v2"]),
    max_size=3))


@SETTINGS
@given(st.lists(label_maps, min_size=1, max_size=15))
def test_first_label_like_dashboard(spark, maps):
    from tidewater.functions import first_label
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)],
                               "i int, labels map<string,string>")
    rows = df.select("labels", first_label("labels", ["spark-role", "app"]).alias("l")).collect()
    for r in rows:
        m = r.labels  # entries in the order Spark holds them (a Python dict's order is not kept)
        if not m:
            want = "—"
        else:
            want = m.get("spark-role") or m.get("app") or list(m.values())[0] or "—"
        assert r.l == want, (m, r.l)
