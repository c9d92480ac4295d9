"""Sketches, bucketed and day-partitioned tables, payloads, CSV lines, reach."""

import datetime as dt
import json
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators.payloads import merged_schema, parse_payloads, payload_fields, payload_report
from tidewater.operators.reach import reachable
from tidewater.operators.sketches import rank_errors, read_sketches, sketch_rows, unite_sketches
from tidewater.plans import ORACLE, QUERIES
from tidewater.plans.sql import run_sql
from tidewater.session import shared_dir
from tidewater.sources.catalog import ensure_database
from tidewater.sources.csvlines import broken_lines, csv_report, read_csv_lines, sound_rows
from tidewater.sources.layout import expire_days, on_days, save_bucketed, save_by_day, upsert_bucketed


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark):
    ensure_database(spark, "test_tables", shared_dir(spark, "test-db"))
    return lambda: f"test_tables.t{uuid.uuid4().hex[:10]}"


# ------------------------------------------------------------------ sketches

QS = [0.01, 0.25, 0.5, 0.9, 0.99]


@pytest.mark.parametrize("rows", [100, 5_000, 200_000])
def test_sketch_errors_at_three_sizes(spark, rows):
    """Within four standard errors, and the union of days as good as one pass."""
    df = spark.range(rows).selectExpr("id % 7 as day", "if(id % 3 = 0, 'hot', concat('k', id % 5)) as k",
                                      "hash(id) % 50000 as who", "sqrt(id * 31 % 10007) as v")
    daily = sketch_rows(df, ["k", "day"], {"n_who": "who"}, {"vs": "v"})
    united = read_sketches(unite_sketches(daily, ["k"], ["n_who"], ["vs"]), ["k"], ["n_who"], ["vs"], QS)
    once = read_sketches(sketch_rows(df, ["k"], {"n_who": "who"}, {"vs": "v"}), ["k"], ["n_who"], ["vs"], QS)
    exact = {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct("who").alias("n")).collect()}
    for est in (united, once):
        got = {r.k: r.n_who for r in est.collect()}
        assert set(got) == set(exact)
        assert all(abs(got[k] - n) <= max(4 * 1.04 / 2 ** 7 * n, 1) for k, n in exact.items())
        errors = rank_errors(df, est, "k", "v", "vs", QS).collect()
        assert len(errors) == len(QS) * len(exact)
        assert max(r.rank_error for r in errors) <= 0.015


def test_sketches_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1, 2.0), (None, 1, None)], "k string, who int, v double")
    est = read_sketches(sketch_rows(df, ["k"], {"n": "who"}, {"q": "v"}), ["k"], ["n"], ["q"], [0.5])
    assert {r.k: (r.n, r.q) for r in est.collect()} == {"a": (0, None), "b": (1, [2.0]), None: (1, None)}
    whole = unite_sketches(sketch_rows(df.limit(0), ["k"], {"n": "who"}, {"q": "v"}), [], ["n"], ["q"])
    assert read_sketches(whole, [], ["n"], ["q"], [0.5]).first().n == 0


# ------------------------------------------------------------ stored layouts

def test_bucketed_upsert_has_no_exchange(spark, table):
    target = spark.range(2000).selectExpr("id as key", "id * 10 as v").unionByName(spark.sql("select cast(null as bigint) key, 7L v"))
    updates = spark.range(1500, 2500).selectExpr("id as key", "-id as v").unionByName(spark.sql("select cast(null as bigint) key, 8L v"))
    updates = updates.unionByName(spark.sql("select 1600L key, 5L v"))
    t, u = table(), table()
    save_bucketed(target, t, "key", 8)
    save_bucketed(updates, u, "key", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = upsert_bucketed(spark.table(t), spark.table(u), "key")
        assert "Exchange" not in plan_of(merged)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = sorted(((r.key, r.v) for r in merged.collect()), key=str)
    want = [(k, k * 10) for k in range(1500)] + [(k, 5 if k == 1600 else -k) for k in range(1500, 2500)] + [(None, 7), (None, 8)]
    assert got == sorted(want, key=str)


def test_bucketed_upsert_with_text_keys(spark, table):
    t, u = table(), table()
    save_bucketed(spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "key string, v int"), t, "key", 4)
    save_bucketed(spark.createDataFrame([("a", 9), ("", 8), (None, 7), ("b", 6)], "key string, v int"), u, "key", 4)
    got = sorted((str(r.key), r.v) for r in upsert_bucketed(spark.table(t), spark.table(u), "key").collect())
    assert got == [("", 2), ("", 8), ("None", 3), ("None", 7), ("a", 9), ("b", 6)]


def test_days_are_pruned_at_run_time(spark, table):
    name = table()
    df = spark.range(1000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 10 as int)) as ts")
    save_by_day(df, name, "ts")
    days = shared_dir(spark, "test-days")
    spark.range(10).selectExpr("date'2024-01-01' + cast(id as int) as day", "id % 4 as n").write.parquet(days)
    got = on_days(spark.table(name), spark.read.parquet(days).filter("n = 2"))
    assert "dynamicpruning" in plan_of(got).lower()
    assert sorted({r.day.day for r in got.collect()}) == [3, 7] and got.count() == 200


def test_old_days_are_dropped(spark, table):
    name = table()
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(20)] + [(99, None)]
    save_by_day(spark.createDataFrame(rows, "id int, ts timestamp_ntz"), name, "ts")
    assert expire_days(spark, name, 7) == [f"2024-01-{d:02}" for d in range(1, 13)]
    assert sorted(r.id for r in spark.table(name).collect()) == [*range(12, 20), 99]
    assert expire_days(spark, name, 7) == []
    empty = table()
    save_by_day(spark.createDataFrame([], "id int, ts timestamp_ntz"), empty, "ts")
    assert expire_days(spark, empty, 7) == []


# ---------------------------------------------------------------- payloads

PAYLOADS = [(1, '{"a": 1, "b": {"c": [1, 2]}}'), (2, '{"a": "7"}'), (3, "{broken"), (4, None), (5, "[1, 2]"), (6, '{"a": null}'), (7, "")]


def test_payload_fields_and_report(spark):
    df = spark.createDataFrame(PAYLOADS, "id int, payload string")
    parsed = parse_payloads(df, "payload", "v", "broken")
    got = payload_fields(parsed, "v", {"a": ("$.a", "int"), "c": ("$.b.c[1]", "int"), "x": ("$.x", "string")}).collect()
    assert {r.id: (r.a, r.c, r.x) for r in got} == {1: (1, 2, None), 2: (7, None, None)} | {i: (None, None, None) for i in (3, 4, 5, 6, 7)}
    assert {r.id for r in got if r.broken} == {3, 7} and {r.payload for r in got} == {p for _, p in PAYLOADS}
    assert tuple(payload_report(df, "payload").first()) == (7, 1, 2, 4)


def test_merged_schema(spark):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([{"a": 1}, {"a": 2, "b": "x"}, {"b": "y", "d": {"e": True}}])], "id int, payload string")
    r = merged_schema(parse_payloads(df, "payload", "v"), "v").first()
    assert r.payload_schema == "OBJECT<a: BIGINT, b: STRING, d: OBJECT<e: BOOLEAN>>" and r.n == 3


# ------------------------------------------------------------- broken lines

def test_csv_folder_loses_no_line(spark):
    folder = shared_dir(spark, "test-csv")
    files = {"a": ["id,name,x", "1,one,1.5", "2,two", "3,three,3.5,more", '4,"a,b",4.5', "x,five,5.5"], "b": ["id,name,x", "6,six,", ",,", "8,eight,abc"]}
    for name, lines in files.items():
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    schema = StructType.fromDDL("id INT, name STRING, x DOUBLE")
    lines = read_csv_lines(spark, f"{folder}/*", schema)
    assert sorted(((r.id, r.name, r.x) for r in sound_rows(lines).collect()), key=str) == sorted(
        [(1, "one", 1.5), (4, "a,b", 4.5), (6, "six", None), (None, None, None)], key=str)
    broken = {r.corrupt_line: r.reason for r in broken_lines(lines).collect()}
    assert broken == {"2,two": "short", "3,three,3.5,more": "long", "x,five,5.5": "type", "8,eight,abc": "type"}
    assert sorted((r.n_lines, r.n_sound, r.n_broken) for r in csv_report(lines).collect()) == [(3, 2, 1), (5, 2, 3)]
    with pytest.raises(ValueError):
        read_csv_lines(spark, folder, StructType.fromDDL("id INT, corrupt_line STRING"))


# ------------------------------------------------------- links to any depth

def test_reach_equals_a_walk(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(330)] + [(1, None), (None, 2), (5, 5), (7, 8), (7, 8)]
    df = spark.createDataFrame(edges, "a int, b int")
    roots = spark.createDataFrame([(1,), (2,), (2,), (None,), (999,)], "n int")
    depth, front, d = {1: 0, 2: 0, 999: 0}, {1, 2, 999}, 0
    while front:
        d += 1
        front = {b for a, b in edges if a in front and b is not None and b not in depth}
        depth |= dict.fromkeys(front, d)
    got = reachable(df, roots, "a", "b", "n").collect()
    assert {r.b: r.depth for r in got} == depth and len(got) == len(depth)
    assert {r.b for r in reachable(df, roots, "a", "b", "n", max_depth=1).collect()} == {k for k, v in depth.items() if v <= 1}
    assert reachable(df, roots.limit(0), "a", "b", "n").count() == 0


def test_sql_recursion_is_not_cut_by_its_rows(spark):
    folder, limit = shared_dir(spark, "test-recursion"), "spark.sql.cteRecursionRowLimit"
    spark.range(300).withColumnRenamed("id", "p_partkey").write.parquet(f"{folder}/part.parquet")
    unset = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "100")  # a million unless set
        got = sorted(map(tuple, QUERIES["sql_recursive"](spark, folder).collect()))
        assert spark.conf.get(limit) == "100" and not spark.catalog.tableExists("part")
    finally:
        spark.conf.unset(limit)
    assert run_sql(spark, "SELECT 1 AS x", settings={limit: "-1"}).first().x == 1
    assert spark.conf.get(limit) == unset != "-1"
    assert got == [(k, min(2 ** (k + 1), 300) - 2 ** k, 2 ** k, min(2 ** (k + 1), 300) - 1) for k in range(9)]


def test_sql_recursion_goes_to_the_last_level(spark):
    folder, limit = shared_dir(spark, "test-levels"), "spark.sql.cteRecursionLevelLimit"
    chain = [2 ** k for k in range(2, 41)]
    spark.createDataFrame([(p,) for p in [None, 0, 2, 3, *chain]], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    try:
        spark.conf.set(limit, "20")  # a hundred unless set
        got = sorted(map(tuple, QUERIES["sql_recursive"](spark, folder).collect()))
        assert spark.conf.get(limit) == "20"
    finally:
        spark.conf.unset(limit)
    assert got == [(0, 1, 1, 1), (1, 2, 2, 3), *((k, 1, p, p) for k, p in enumerate(chain, 2))]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLE["sql_recursive"]).fetchall())


def test_a_timed_job_reports_rows_and_time(spark):
    from tidewater.operators.timing import run_timed
    r = run_timed("ten", lambda: spark.range(10).filter("id > 3"))
    assert (r["job"], r["rows"]) == ("ten", 6) and r["seconds"] > 0
    folder = shared_dir(spark, "test-timed")
    assert run_timed("written", lambda: spark.range(7), lambda df: df.write.parquet(folder))["rows"] == 7
    assert spark.read.parquet(folder).count() == 7
