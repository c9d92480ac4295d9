import datetime as dt

from pyspark.sql import functions as F

from tidewater.functions import (classify_by_keys, content_type_for, derive_key, display_ts,
                                 file_extension, first_label, flatten_app_record, iso_ts,
                                 lookup_default, rewrite_links, status_class, status_text,
                                 TYPE_CLASSES)

SPARK_KEYS = ["spark-role", "spark-app-name"]


def test_pods_classification(spark):
    rows = [(1, None), (2, {}), (3, {"spark-role": "driver"}), (4, {"spark-app-name": "a"}),
            (5, {"spark-role": ""})]
    df = spark.createDataFrame(rows, "id int, labels map<string,string>")
    got = [r.c for r in df.select(classify_by_keys("labels", SPARK_KEYS).alias("c"))
           .orderBy(F.lit(1)).collect()]
    assert sorted(zip([r[0] for r in rows], got)) == [
        (1, "infra"), (2, "infra"), (3, "spark"), (4, "spark"), (5, "spark")]


def test_statuses(spark):
    raw = ["Running", "SUCCEEDED", "ContainerCreating", "Error", "", None, "Evicted"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(raw)], "i int, s string")
    out = {r.i: (r.t, r.c) for r in df.select(
        "i", status_text("s").alias("t"), status_class("s").alias("c")).collect()}
    assert [out[i][1] for i in range(7)] == ["running", "completed", "pending", "failed",
                                             "unknown", "unknown", "unknown"]
    assert out[0][0] == "running" and out[4][0] == "unknown" and out[6][0] == "evicted"


def test_type_lookup(spark):
    from tidewater.functions import display_or_dash
    df = spark.createDataFrame([("Scala",), ("Python",), ("Go",), (None,), ("",)], "t string")
    got = [(r.c, r.d) for r in df.select(lookup_default("t", TYPE_CLASSES).alias("c"),
                                         display_or_dash("t").alias("d")).collect()]
    assert got == [("scala", "Scala"), ("python", "Python"), ("unknown", "Go"),
                   ("unknown", "—"), ("unknown", "—")]


def test_labels_display(spark):
    rows = [(1, {"spark-role": "", "app": "web"}), (2, {"x": "only"}), (3, {}), (4, None),
            (5, {"spark-role": "driver", "app": "web"})]
    df = spark.createDataFrame(rows, "id int, labels map<string,string>")
    got = {r.id: r.l for r in df.select("id", first_label("labels", ["spark-role", "app"])
                                        .alias("l")).collect()}
    assert got == {1: "web", 2: "only", 3: "—", 4: "—", 5: "driver"}


def test_apps_json(spark):
    docs = [
        '{"metadata": {"name": "a", "namespace": "spark"}, "spec": {"type": "Scala"}}',
        '{"metadata": {"name": "b"}, "spec": {}, "status": {"applicationState": {}}}',
        '{"metadata": {"name": "c", "creationTimestamp": "2024-01-01T00:00:00Z"},'
        ' "spec": {"type": "Python", "image": "img"},'
        ' "status": {"applicationState": {"state": "FAILED", "errorMessage": "boom"}}}',
    ]
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    r = {x.name: x for x in df.select(flatten_app_record("j").alias("r")).select("r.*").collect()}
    assert (r["a"].state, r["a"].message, r["a"].image) == ("UNKNOWN", "", None)
    assert (r["b"].state, r["b"].message) == ("UNKNOWN", "")
    assert (r["c"].state, r["c"].message, r["c"].type, r["c"].created) == \
        ("FAILED", "boom", "Python", "2024-01-01T00:00:00Z")


def test_file_names(spark):
    names = ["a.PY", "b.jar", "c.txt", "noext", "d.tar.jar", ".py", "jobs/e.py", "dir.x/noext"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = {r.name: (r.ext, r.ct) for r in df.select(
        "name", file_extension("name").alias("ext"),
        content_type_for(file_extension("name")).alias("ct")).collect()}
    import os.path
    for n in names:
        assert out[n][0] == os.path.splitext(n)[1].lower(), n
    kept = sorted(n for n, (e, _) in out.items() if e in (".py", ".jar"))
    assert kept == ["a.PY", "b.jar", "d.tar.jar", "jobs/e.py"]
    assert out["a.PY"][1] == "text/x-python" and out["b.jar"][1] == "application/octet-stream"


def test_html_rewrite(spark):
    rows = [('<a href="/x">', "text/html"), ('<img src="/y">', "text/html"),
            ('<form action="/z">', "text/html"), ('<a href="//h">', "text/html"),
            ("<a href='/q'>", "text/html"), ('<a href="/x">', "application/json")]
    df = spark.createDataFrame(rows, "html string, ct string")
    got = [r.o for r in df.select(rewrite_links("html", "/p/", "ct").alias("o")).collect()]
    assert got == ['<a href="/p/x">', '<img src="/p/y">', '<form action="/p/z">',
                   '<a href="/p//h">', "<a href='/q'>", '<a href="/x">']


def test_driver_names(spark):
    rows = [("a-driver", None), ("a-driver-driver", ""), ("plain", None), ("x-driver", "sel")]
    df = spark.createDataFrame(rows, "name string, sel string")
    got = [r.k for r in df.select(derive_key("sel", "name").alias("k")).collect()]
    expect = [(s or n.rsplit("-driver", 1)[0]) for n, s in rows]
    assert got == expect == ["a", "a-driver", "plain", "sel"]


def test_iso_and_display(spark):
    rows = [(dt.datetime(2024, 1, 5, 9, 7, 3),), (dt.datetime(2024, 1, 5, 9, 7, 3, 120),), (None,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = df.select(iso_ts("ts").alias("i"), display_ts("ts").alias("d")).collect()
    assert [r.i for r in got] == [rows[0][0].isoformat(), rows[1][0].isoformat(), None]
    assert [r.d for r in got] == ["05 Jan, 09:07", "05 Jan, 09:07", "—"]


def test_iso_with_offset(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5, 9, 7, 3, tzinfo=dt.timezone.utc),)],
                               "ts timestamp")
    r = df.select(iso_ts("ts", with_offset=True).alias("i")).collect()[0]
    assert r.i == "2024-01-05T09:07:03+00:00"


def test_every_quantity_unit_is_read(spark):
    from tidewater.functions.strings import parse_cpu_millis, parse_mem_mib
    from tidewater.operators import rollup_totals
    rows = [("5n", "1Pi"), ("7u", "1Ei"), ("3m", "1T"), ("2", "1P"), ("1x", "1E"), (None, "1Q")]
    df = spark.createDataFrame(rows, "cpu string, mem string").withColumn("k", F.lit("a"))
    got = [(r.c and round(r.c, 9), r.m) for r in df.select(parse_cpu_millis("cpu").alias("c"), parse_mem_mib("mem").alias("m")).collect()]
    mib = 2.0 ** 20
    assert got == [(5e-6, 2.0 ** 30), (7e-3, 2.0 ** 40), (3.0, 1e12 / mib), (2000.0, 1e15 / mib), (None, 1e18 / mib), (None, None)]
    totals = rollup_totals(df, ["k"], {"c": parse_cpu_millis("cpu"), "m": parse_mem_mib("mem")},
                           unread={"c_unread": ("c", "cpu"), "m_unread": ("m", "mem")})
    assert {(r.gid, r.c_unread, r.m_unread) for r in totals.collect()} == {(0, 1, 1), (1, 1, 1)}


def test_hints_stay_in_statements():
    from tidewater.plans.sql import split_statements
    assert split_statements("select /*+ BROADCAST(a) */ 1 /* no */ -- no\n; x") == ["select /*+ BROADCAST(a) */ 1", "x"]


def test_rank_by_the_key_itself(spark):
    from tidewater.operators import rank_within_key
    df = spark.range(6).selectExpr("id % 2 as k", "id")
    assert {(r["rank"], r.d) for r in rank_within_key(df, "k", ["k"], dense_col="d").collect()} == {(1, 1)}
    got = {r.id: r["rank"] for r in rank_within_key(df, "k", ["k", "id"], [True, False]).collect()}
    assert got == {0: 3, 1: 3, 2: 2, 3: 2, 4: 1, 5: 1}
