import os

from test_history import write_log
from tidewater import jobs
from tidewater.session import shared_dir
from tidewater.sources import SourceSpec


def test_counter_job(spark, capsys):
    stats = jobs.counter(spark, 100_000, 10)
    assert stats["n"] == 99_999 and stats["even"] == 49_999 and stats["odd"] == 50_000
    out = capsys.readouterr().out
    assert " count  99,999" in out and "  mean  50,000.00" in out


def test_wordcount_job(spark, sf_small):
    out = shared_dir(spark, "test-wc")
    jobs.wordcount(spark, SourceSpec("parquet", f"{sf_small}/documents.parquet"), out)
    assert spark.read.parquet(out).filter("word = ''").count() == 0
    assert spark.read.parquet(out).count() > 100


def test_inspect_job(spark, capsys):
    d = shared_dir(spark, "test-inspect")
    local = d[len("file:"):] if d.startswith("file:") else d
    os.makedirs(local)
    with open(f"{local}/a.csv", "w") as f:
        f.write("id,name\n1,x\n2,y\n")
    df = jobs.inspect(spark, SourceSpec.from_config({"app": {"file": {"inputPath": local}}}))
    assert df.count() == 2
    assert "column_name" in capsys.readouterr().out


def test_sql_job_script(spark, sf_small, capsys):
    df = jobs.sql(spark, sf_small, "SELECT r_name FROM region WHERE r_regionkey < 2; "
                                   "SELECT count(*) AS n FROM nation")
    assert df.collect()[0].n == 25
    assert "n" in capsys.readouterr().out


def test_reconcile_job(spark, sf_small):
    out = shared_dir(spark, "test-reconcile-job")
    src = shared_dir(spark, "test-reconcile-src")
    spark.createDataFrame([("a",), ("b",)], "key string").write.parquet(src + "/d")
    spark.createDataFrame([("b",), ("c",)], "key string").write.parquet(src + "/a")
    jobs.reconcile_job(spark, SourceSpec("parquet", src + "/d"), SourceSpec("parquet", src + "/a"),
                       "key", out)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("a", "create"), ("b", "keep"), ("c", "delete")]


def test_bronze_job(spark, sf_small):
    root = shared_dir(spark, "test-bronze-job")
    src = root + "/in"
    spark.read.parquet(f"{sf_small}/events.parquet").write.parquet(src)
    jobs.bronze(spark, src, root + "/out", root + "/ckpt", trigger="availableNow")
    assert spark.read.parquet(root + "/out").count() == 1000


def test_bronze_job_into_a_table_keeps_payloads(spark):
    root = shared_dir(spark, "test-bronze-table")
    lines = ['{"event_id":1,"ts":"2024-01-01T00:00:00","user_id":2,"event_type":"view","value":1.5,"props":"{}"}',
             '{"event_id":2,"ts":"2024-01-01T00:00:00.25","user_id":2,"event_type":"view","value":1.5,"props":"{}"}',
             "no json"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(root + "/in")
    name = "bronze_" + root.rsplit("-", 1)[-1]
    jobs.bronze(spark, root + "/in", None, root + "/ckpt", "availableNow", "text", table=name)
    rows = {r.raw: r for r in spark.table(name).collect()}
    assert set(rows) == set(lines)
    assert str(rows[lines[0]].ts) == "2024-01-01 00:00:00" and rows[lines[1]].ts.microsecond == 250000
    assert rows["no json"].event_id is None
    spark.sql(f"DROP TABLE {name}")


def test_validate_job(spark):
    root = shared_dir(spark, "test-validate-job")
    lines = ['{"event_id":1,"ts":"2024-01-01T00:00:00","user_id":2,"event_type":"view","value":1.5,"props":"{}"}', "no json"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(root + "/in")
    jobs.validate(spark, root + "/in", root + "/out", root + "/ckpt", "availableNow", "text")
    got = {r.raw: (r.status, r.reject_reason) for r in spark.read.parquet(root + "/out").collect()}
    assert got == {lines[0]: ("valid", None), "no json": ("quarantine", "missing_key")}


def test_kafka_wiring(monkeypatch, spark):
    spec = jobs.event_spec(None, "broker:9092", "raw-events")
    assert (spec.kind, spec.topic, spec.bootstrap_servers) == ("kafka", "raw-events", "broker:9092")
    seen = {}
    topic = spark.createDataFrame([(b"k", b'{"event_id":7}', "raw-events", 0, 5)],
                                  "key binary, value binary, topic string, partition int, offset long")
    monkeypatch.setattr(jobs, "event_source", lambda s, sp: seen.update(spec=sp) or topic)
    row = jobs.events_of(spark, spec, keep_raw=True).first()
    assert seen["spec"] is spec and row.event_id == 7 and row.raw == '{"event_id":7}'
    assert (row.topic_key, row.topic_topic, row.topic_partition, row.topic_offset) == ("k", "raw-events", 0, 5)


def test_sql_statements_split_outside_of_quotes(spark, sf_small):
    from tidewater.plans.sql import split_statements
    assert split_statements("select 'a;b' as x; -- not; here\nselect \"c;d\" /* ; */ ;") == [
        "select 'a;b' as x", 'select "c;d"']
    assert jobs.sql(spark, None, "select 'a;b' as x").first().x == "a;b"


def test_sql_leaves_a_users_view(spark, sf_small):
    from tidewater.plans.sql import run_sql
    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("region")
    assert run_sql(spark, "SELECT count(*) AS n FROM region", sf_small).first().n == 5
    assert spark.table("region").columns == ["mine"]
    spark.catalog.dropTempView("region")
    run_sql(spark, "SELECT * FROM nation", sf_small).count()
    assert not spark.catalog.tableExists("nation")


def test_history_job(spark, sf_small):
    out = shared_dir(spark, "test-history-job")
    logs = shared_dir(spark, "test-history-logs")
    write_log(spark, logs)
    jobs.history(spark, logs, out)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1 and rows[0].n_tasks == 2


def _main(monkeypatch, spark, *args):
    monkeypatch.setattr(jobs, "get_spark", lambda name: spark)
    jobs.main(list(args))


def test_dedup_windows_and_silent_jobs(monkeypatch, spark, capsys):
    root = shared_dir(spark, "test-stream-jobs")

    def line(i, minute, user):
        return (f'{{"event_id":{i},"ts":"2024-01-01T{minute // 60:02}:{minute % 60:02}:00","user_id":{user},'
                f'"event_type":"view","value":1.5,"props":"{{}}"}}',)

    rows = [line(1, 0, 1), line(1, 0, 1), line(2, 10, 1), line(3, 200, 2), line(4, 700, 3)]
    spark.createDataFrame(rows, "value string").write.text(root + "/in")
    common = lambda job: (job, "--source", root + "/in", "--format", "text", "--out", f"{root}/{job}", "--checkpoint", f"{root}/ck-{job}", "--delay", "10 minutes")
    _main(monkeypatch, spark, *common("dedup"))
    assert "rows=5" in (out := capsys.readouterr().out) and "repeats=1" in out
    assert sorted(r.event_id for r in spark.read.parquet(root + "/dedup").collect()) == [1, 2, 3, 4]
    _main(monkeypatch, spark, *common("windows"), "--size", "1 hour")
    got = {(r.window_start.hour, r.event_type): (r.n, float(r.total_value)) for r in spark.read.parquet(root + "/windows").collect()}
    assert got == {(0, "view"): (3, 4.5), (3, "view"): (1, 1.5)}
    _main(monkeypatch, spark, *common("silent"), "--quiet", "1 hour")
    assert sorted((r.user_id, r.n_events) for r in spark.read.parquet(root + "/silent").collect()) == [(1, 3), (2, 1)]


def test_csvlines_job(monkeypatch, spark, capsys):
    root = shared_dir(spark, "test-csvlines-job")
    spark.createDataFrame([("id,name\n1,a\n2\nx,c",)], "value string").coalesce(1).write.text(root + "/in")
    _main(monkeypatch, spark, "csvlines", "--path", root + "/in", "--schema", "id INT, name STRING", "--out", root + "/out")
    assert [tuple(r) for r in spark.read.parquet(root + "/out/rows").collect()] == [(1, "a")]
    assert sorted((r.corrupt_line, r.reason) for r in spark.read.parquet(root + "/out/broken").collect()) == [("2", "short"), ("x,c", "type")]
    assert "n_broken" in capsys.readouterr().out
