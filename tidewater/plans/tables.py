"""Queries over stored layouts and loose inputs: sketches, bucketed and
day-partitioned tables, payloads of unknown shape, broken CSV lines, links to
any depth."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewater.operators.payloads import merged_schema, parse_payloads, payload_fields, payload_report
from tidewater.operators.reach import reachable
from tidewater.operators.sketches import rank_errors, read_sketches, sketch_rows, unite_sketches
from tidewater.operators.timing import run_timed
from tidewater.plans.registry import query
from tidewater.plans.shapes import _shape
from tidewater.session import shared_dir
from tidewater.sources.catalog import ensure_database
from tidewater.sources.csvlines import broken_lines, read_csv_lines, sound_rows
from tidewater.sources.files import SourceSpec, load_source, read_table
from tidewater.sources.layout import expire_days, on_days, save_bucketed, save_by_day, upsert_bucketed


def _table_name(spark: SparkSession, base: str) -> str:
    """A new table in a database whose files are in the shared folder."""
    ensure_database(spark, "tidewater_tables", shared_dir(spark, "tables"))
    return f"tidewater_tables.{base}_{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------------ sketches

SKETCH_QS = (0.05, 0.5, 0.95)


@query("sketch_totals", """
WITH x AS (SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT event_id) AS events FROM events GROUP BY event_type)
SELECT event_type, users, events, true AS users_near, true AS events_near, true AS ranks_near FROM x
""")
def q_sketch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users and events and value quantiles per type from sketches
    stored per day and type and united afterwards, held against exact counts:
    distinct counts within 4 %, ranks within 2 %."""
    ev = read_table(spark, d, "events")
    stored = shared_dir(spark, "sketches")
    (sketch_rows(ev.withColumn("day", F.col("ts").cast("date")), ["event_type", "day"], {"users": "user_id", "events": "event_id"}, {"value": "value"})
     .write.parquet(stored))
    united = unite_sketches(spark.read.parquet(stored), ["event_type"], ["users", "events"], ["value"])
    est = read_sketches(united, ["event_type"], ["users", "events"], ["value"], SKETCH_QS)
    ranks = (rank_errors(ev, est, "event_type", "value", "value", SKETCH_QS).groupBy("event_type")
             .agg((F.max("rank_error") <= 0.02).alias("ranks_near")))
    exact = ev.groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_id").alias("n_events"))

    def near(estimate: str, count: str):
        return F.abs(F.col(estimate) - F.col(count)) <= F.greatest(F.col(count) * 0.04, F.lit(1))

    return (exact.join(est, F.col("kind").eqNullSafe(F.col("event_type"))).join(ranks, "event_type")
            .select("event_type", F.col("n_users").alias("users"), F.col("n_events").alias("events"),
                    near("users", "n_users").alias("users_near"), near("events", "n_events").alias("events_near"), "ranks_near"))


# ------------------------------------------------------------ stored layouts

@query("upsert_bucketed", """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL
SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey > 0
""")
def q_upsert_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Changed and new orders merged into a table bucketed alike."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = orders.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    fresh = orders.filter("o_orderkey % 7 = 0 AND o_orderkey > 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target, updates = _table_name(spark, "target"), _table_name(spark, "updates")
    save_bucketed(orders, target, "o_orderkey", buckets)
    save_bucketed(changed.unionByName(fresh), updates, "o_orderkey", buckets)
    return upsert_bucketed(spark.table(target), spark.table(updates), "o_orderkey")


@query("pruned_days", """
WITH busy AS (SELECT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) % 2 = 0)
SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) IN (SELECT day FROM busy)
""")
def q_pruned_days(spark: SparkSession, d: str) -> DataFrame:
    """Events of the days with an even number of errors, from a table by day:
    which partitions are read is decided at run time."""
    ev = read_table(spark, d, "events")
    name = _table_name(spark, "days")
    save_by_day(ev, name, "ts")
    errors = ev.filter("event_type = 'error'").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    counts = shared_dir(spark, "error-days")
    errors.write.parquet(counts)
    return on_days(spark.table(name), spark.read.parquet(counts).filter("n % 2 = 0"))


@query("expire_days", """
SELECT event_id, ts, user_id, event_type, value, props, CAST(ts AS DATE) AS day FROM events
WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) - 7 FROM events)
""")
def q_expire_days(spark: SparkSession, d: str) -> DataFrame:
    """Retention by dropping partitions older than seven days before the newest."""
    name = _table_name(spark, "retained")
    save_by_day(read_table(spark, d, "events"), name, "ts")
    expire_days(spark, name, 7)
    return spark.table(name)


# ---------------------------------------------------------------- payloads

_PAYLOADS_SQL = """
WITH p AS (SELECT event_id, event_type, CASE
    WHEN event_id % 17 = 0 THEN NULL
    WHEN event_id % 13 = 0 THEN 'x' || props
    WHEN event_id % 5 = 0 THEN '{"k":"' || event_id || '","tag":"t' || event_id % 3 || '","deep":{"n":' || event_id % 10 || '.5}}'
    ELSE props END AS payload FROM events)
"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Event payloads of three shapes, with some missing and some broken."""
    i = F.col("event_id")
    odd = F.concat(F.lit('{"k":"'), i.cast("string"), F.lit('","tag":"t'), (i % 3).cast("string"), F.lit('","deep":{"n":'),
                   (i % 10).cast("string"), F.lit(".5}}"))
    payload = (F.when(i % 17 == 0, F.lit(None).cast("string")).when(i % 13 == 0, F.concat(F.lit("x"), F.col("props")))
               .when(i % 5 == 0, odd).otherwise(F.col("props")))
    return read_table(spark, d, "events").select("event_id", "event_type", payload.alias("payload"))


@query("payload_fields", _PAYLOADS_SQL + """
SELECT event_id, TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) AS k, json_extract_string(j, '$.tag') AS tag,
       TRY_CAST(json_extract_string(j, '$.deep.n') AS DOUBLE) AS n, payload IS NOT NULL AND j IS NULL AS broken
FROM (SELECT *, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM p)
""")
def q_payload_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of payloads whose shape is not declared: a number that is text
    in some of them, a text and a nested number that only some have."""
    parsed = parse_payloads(_payloads(spark, d), "payload", "v", "broken")
    fields = payload_fields(parsed, "v", {"k": ("$.k", "bigint"), "tag": ("$.tag", "string"), "n": ("$.deep.n", "double")})
    return fields.select("event_id", "k", "tag", "n", "broken")


@query("payload_report", _PAYLOADS_SQL + """
SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE payload IS NULL) AS n_missing,
       count(*) FILTER (WHERE payload IS NOT NULL AND NOT json_valid(payload)) AS n_broken,
       count(*) FILTER (WHERE json_valid(payload)) AS n_read
FROM p GROUP BY event_type
""")
def q_payload_report(spark: SparkSession, d: str) -> DataFrame:
    return payload_report(_payloads(spark, d), "payload", ["event_type"])


@query("payload_schema", _PAYLOADS_SQL + """
SELECT 'OBJECT<deep: OBJECT<n: DECIMAL(2,1)>, k: VARIANT, tag: STRING>' AS payload_schema, count(*) FILTER (WHERE json_valid(payload)) AS n FROM p
""")
def q_payload_schema(spark: SparkSession, d: str) -> DataFrame:
    """The one schema that holds all payloads; a field that is a number here
    and text there stays a variant."""
    return merged_schema(parse_payloads(_payloads(spark, d), "payload", "v"), "v")


# ------------------------------------------------------------- broken lines

_LINES = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()), StructField("o_orderstatus", StringType()),
                     StructField("o_totalprice", DoubleType()), StructField("o_orderpriority", StringType())])


@query("csv_broken_lines", """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'short' WHEN o_orderkey % 13 = 0 THEN 'long'
                          WHEN o_orderkey % 17 = 0 THEN 'type' END AS reason FROM orders)
SELECT CASE WHEN reason IS NULL THEN o_orderkey END AS o_orderkey, CASE WHEN reason IS NULL THEN o_custkey END AS o_custkey,
       CASE WHEN reason IS NULL THEN o_totalprice END AS o_totalprice,
       CASE WHEN reason IS NULL THEN o_orderpriority END AS o_orderpriority, reason,
       CASE WHEN reason IS NOT NULL THEN CAST(o_orderkey AS VARCHAR) END AS broken_key
FROM o
""")
def q_csv_broken_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as CSV lines, some cut off, some with a field too many, some
    with text for a number: sound rows are read, no line is lost."""
    folder = shared_dir(spark, "broken-csv")
    k = F.col("o_orderkey")
    whole = [k.cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("string"), F.col("o_orderpriority")]
    line = (F.when(k % 11 == 0, F.concat_ws(",", *whole[:3])).when(k % 13 == 0, F.concat_ws(",", *whole, F.lit("more")))
            .when(k % 17 == 0, F.concat_ws(",", whole[0], F.lit("abc"), *whole[2:])).otherwise(F.concat_ws(",", *whole)))
    read_table(spark, d, "orders").select(line.alias("value")).write.text(folder)
    lines = read_csv_lines(spark, folder, _LINES, {"header": "false"})
    sound = sound_rows(lines).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    broken = broken_lines(lines).select("reason", F.substring_index("corrupt_line", ",", 1).alias("broken_key"))
    return sound.unionByName(broken, allowMissingColumns=True)


# ------------------------------------------------------- links to any depth

_LINKS_SQL = """
links AS (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part
          UNION ALL SELECT p_partkey AS parent, p_partkey // 8 AS child FROM part WHERE p_partkey % 97 = 0)
"""


@query("dependants", "WITH RECURSIVE " + _LINKS_SQL + """,
r(node, depth) AS (SELECT node, 0 FROM (VALUES (3), (5)) v(node)
                   UNION SELECT child, depth + 1 FROM r JOIN links ON parent = node WHERE depth < 25)
SELECT CAST(node AS BIGINT) AS child, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node
""")
def q_dependants(spark: SparkSession, d: str) -> DataFrame:
    """All parts under two roots of a tree with links back up (cycles)."""
    part = read_table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("p"))
    links = (part.select(F.floor(F.col("p") / 2).alias("parent"), F.col("p").alias("child"))
             .unionByName(part.filter("p % 97 = 0").select(F.col("p").alias("parent"), F.floor(F.col("p") / 8).alias("child"))))
    roots = part.filter("p IN (3, 5)").select(F.col("p").alias("node"))
    return reachable(links, roots, "parent", "child", "node")


# A recursion ends with an error at a million rows or a hundred levels unless
# told otherwise; this one ends by itself, as a child is larger than its parent.
_shape("sql_recursive", """
WITH RECURSIVE links AS (SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS parent, CAST(p_partkey AS BIGINT) AS child FROM part),
r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0
                   UNION ALL SELECT child, depth + 1 FROM r JOIN links ON parent = node)
SELECT depth, count(*) AS n, min(node) AS least, max(node) AS greatest FROM r GROUP BY depth
""", settings={"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"})


# ------------------------------------------------- other schemes, timed jobs

@query("object_store_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def q_object_store_scan(spark: SparkSession, d: str) -> DataFrame:
    """A configured source under a path of another Hadoop scheme: the folder
    is mounted in a ViewFs name space, whose options are session settings as
    those of an object store are. A folder that is in such a store is read
    from there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(d.rstrip("/"))
    if not path.toUri().getScheme() or path.toUri().getScheme() == "file":
        mount = f"store{uuid.uuid4().hex[:8]}"
        spark.conf.set(f"fs.viewfs.mounttable.{mount}.link./data", path.toUri().getPath() if not path.toUri().getScheme() else d.rstrip("/"))
        d = f"viewfs://{mount}/data"
    spec = SourceSpec.from_config({"app": {"file": {"inputPath": f"{d.rstrip('/')}/orders.parquet", "format": "parquet"}}})
    return load_source(spark, spec).filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("timed_jobs", """
SELECT 'orders' AS job, count(*) AS rows, true AS timed FROM orders
UNION ALL SELECT 'open orders', count(*), true FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT 'lines by flag', count(DISTINCT l_returnflag), true FROM lineitem
""")
def q_timed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Three jobs, each run once, with the rows that it gave and whether its
    time was taken (the time itself is different on every run)."""
    orders = read_table(spark, d, "orders")
    done = [run_timed("orders", lambda: orders), run_timed("open orders", lambda: orders.filter("o_orderstatus = 'O'")),
            run_timed("lines by flag", lambda: read_table(spark, d, "lineitem").groupBy("l_returnflag").count())]
    report = spark.createDataFrame([(r["job"], r["rows"], r["seconds"]) for r in done], "job string, rows long, seconds double")
    return report.select("job", "rows", (F.col("seconds") > 0).alias("timed"))
