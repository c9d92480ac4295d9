from pyspark.sql import functions as F

from tidewater.functions import parse_cpu_millis, parse_mem_mib
from tidewater.operators import (agg_by_map, conditional_counts, format_stats, one_pass_stats,
                                 range_stats, rollup_totals, status_metrics)


def test_range_golden(spark):
    r = range_stats(spark, 100000, 10).collect()[0].asDict()
    assert r == {"n": 99999, "total": 4999950000, "mean": 50000.0, "min_value": 1,
                 "max_value": 99999, "even": 49999, "odd": 50000}


def test_range_stats_is_one_aggregate_without_python(spark):
    plan = range_stats(spark, 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2  # partial + final of ONE aggregate
    assert "Python" not in plan


def test_odd_negative(spark):
    df = spark.createDataFrame([(-3,), (-2,), (0,)], "x long")
    r = one_pass_stats(df, "x").collect()[0]
    assert (r.odd, r.even) == (1, 2)


def test_parity_golden(spark):
    n = F.col("id")
    df = spark.range(1, 101).select(n.alias("number"), (n * 2).alias("doubled"),
                                    F.when(n % 2 == 0, "even").otherwise("odd").alias("type"))
    out = {r.type: (r.sum_number, r.avg_doubled)
           for r in agg_by_map(df, ["type"], {"number": "sum", "doubled": "avg"}).collect()}
    assert out == {"even": (2550, 102.0), "odd": (2500, 100.0)}
    assert agg_by_map(df, ["type"], {"number": "sum", "doubled": "avg"}).columns == \
        ["type", "sum_number", "avg_doubled"]


def test_conditional_counts(spark):
    df = spark.range(1, 11)
    r = conditional_counts(df, {"big": F.col("id") > 7, "small": F.col("id") < 3}).collect()[0]
    assert (r.n, r.big, r.small) == (10, 3, 2)


def test_format_stats(spark):
    df = spark.createDataFrame([(1234567.0,), (1.0,)] + [(0.5,)] * 1998, "x double")
    r = format_stats(df, "x").collect()[0]
    assert r.count_text == "2,000"
    assert r.mean_text == f"{(1234567.0 + 1.0 + 0.5 * 1998) / 2000:,.2f}"


def test_status_metrics_fixture(spark):
    pods = spark.createDataFrame(
        [("Running", {"spark-role": "driver"}), ("Failed", None), ("error", {"app": "x"})],
        "status string, labels map<string,string>")
    apps = spark.createDataFrame([("RUNNING",), ("FAILED",)], "state string")
    r = status_metrics(pods, apps).collect()[0].asDict()
    assert r == {"total_pods": 3, "running_pods": 1, "active_apps": 1, "failed": 2,
                 "spark_pods": 1, "infra_pods": 2, "total_apps": 2}


def test_quantities_rollup(spark):
    # The seven resource rows of the setup notes.
    rows = [("Kafka broker", "250m", "512Mi"), ("Kafka controller", "100m", "256Mi"),
            ("Hive Metastore", "250m", "512Mi"), ("PostgreSQL", "250m", "512Mi"),
            ("MinIO", "200m", "256Mi"), ("Spark driver", "1000m", "512Mi"),
            ("Spark Dashboard", "100m", "128Mi")]
    df = spark.createDataFrame(rows, "component string, cpu string, memory string")
    out = rollup_totals(df, ["component"], {"cpu_m": parse_cpu_millis("cpu"),
                                            "mem_mi": parse_mem_mib("memory")})
    total = out.filter("gid = 1").collect()
    assert len(total) == 1 and total[0].cpu_m == 2150.0 and total[0].mem_mi == 2688.0
    assert out.filter("gid = 0").count() == 7


def test_quantity_units(spark):
    df = spark.createDataFrame([("2", "1Gi"), ("0.5", "1024Ki"), ("bad", "x")], "c string, m string")
    r = df.select(parse_cpu_millis("c").alias("c"), parse_mem_mib("m").alias("m")).collect()
    assert (r[0].c, r[0].m) == (2000.0, 1024.0)
    assert (r[1].c, r[1].m) == (500.0, 1.0)
    assert (r[2].c, r[2].m) == (None, None)
