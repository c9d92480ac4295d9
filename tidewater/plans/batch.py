"""Batch queries over the given tables (statistics, column work, keyed
relations), each next to its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import (classify_by_keys, content_type_for, derive_key,
                                 display_or_dash, display_ts,
                                 file_extension, first_label, flatten_app_record, iso_ts,
                                 lookup_default, parse_cpu_millis, parse_mem_mib,
                                 rewrite_links, status_class, status_text, TYPE_CLASSES)
from tidewater.functions.labels import SPARK_KEYS
from tidewater.operators import (agg_by_map, conditional_counts, delete_by_key, dependent_rows,
                                 describe_schema, filter_eq, filter_in, filter_not_contains,
                                 format_stats, head_n, insert_if_absent, latest_by_key,
                                 one_pass_stats, range_stats, reconcile, retention_filter,
                                 order_parts, rollup_totals, range_join, split_explode, stale_rows,
                                 status_metrics, tail_n_per_key, upsert_by_key,
                                 word_count)
from tidewater.operators.frames import (frame_sum, neighbours_within_key,
                                        range_count_within_key)
from tidewater.operators.hotkeys import by_key_size
from tidewater.operators.quality import quarantined, validated
from tidewater.operators.ranking import ntile_from, rank_within_key, row_number_within_key
from tidewater.plans.registry import query
from tidewater.session import shared_dir
from tidewater.sources import SourceSpec, load_source, read_table
from tidewater.sources.catalog import append_table, drop_table, read_catalog_table, save_table
from tidewater.streaming.decode import decode_events, encode_events


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


# ---------------------------------------------------------------- statistics

_STATS_SQL = """
SELECT count(x) AS n, CAST(sum(x) AS DECIMAL(38,0)) AS total, avg(x) AS mean,
       min(x) AS min_value, max(x) AS max_value,
       count(*) FILTER (WHERE x % 2 = 0) AS even,
       count(*) FILTER (WHERE x % 2 <> 0) AS odd
"""


@query("range_stats", _STATS_SQL + """
FROM (SELECT unnest(range(1, (SELECT count(*) FROM lineitem) + 1)) AS x)
""")
def q_range_stats(spark: SparkSession, d: str) -> DataFrame:
    """The number sequence 1..N, N = rows of lineitem, generated on the
    executors; all seven statistics in one aggregate."""
    n = _t(spark, d, "lineitem").count()
    return range_stats(spark, n + 1)


@query("column_stats", _STATS_SQL + "FROM (SELECT o_orderkey AS x FROM orders)")
def q_column_stats(spark: SparkSession, d: str) -> DataFrame:
    return one_pass_stats(_t(spark, d, "orders"), "o_orderkey")


def _parity(orders: DataFrame) -> DataFrame:
    n = F.col("o_orderkey")
    return orders.select(n.alias("number"), (n * 2).alias("doubled"),
                         F.when(n % 2 == 0, F.lit("even")).otherwise(F.lit("odd")).alias("type"))


_PARITY_SQL = """
SELECT o_orderkey AS number, o_orderkey * 2 AS doubled,
       CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS type
FROM orders
"""


@query("parity_table", _PARITY_SQL)
def q_parity_table(spark: SparkSession, d: str) -> DataFrame:
    return _parity(_t(spark, d, "orders"))


@query("group_sum_avg", f"""
SELECT type, CAST(sum(number) AS DECIMAL(38,0)) AS sum_number, avg(doubled) AS avg_doubled
FROM ({_PARITY_SQL}) GROUP BY type
""")
def q_group_sum_avg(spark: SparkSession, d: str) -> DataFrame:
    return agg_by_map(_parity(_t(spark, d, "orders")), ["type"],
                      {"number": "sum", "doubled": "avg"})


@query("agg_by_map", """
SELECT o_orderpriority, CAST(sum(o_orderkey) AS DECIMAL(38,0)) AS sum_o_orderkey,
       avg(o_custkey) AS avg_o_custkey, max(o_totalprice) AS max_o_totalprice,
       count(o_orderstatus) AS count_o_orderstatus
FROM orders GROUP BY o_orderpriority
""")
def q_agg_by_map(spark: SparkSession, d: str) -> DataFrame:
    return agg_by_map(_t(spark, d, "orders"), ["o_orderpriority"],
                      {"o_orderkey": "sum", "o_custkey": "avg", "o_totalprice": "max",
                       "o_orderstatus": "count"})


@query("filter_even", "SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def q_filter_even(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").filter(F.col("o_orderkey") % 2 == 0)


@query("filter_odd", "SELECT * FROM orders WHERE o_orderkey % 2 <> 0")
def q_filter_odd(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").filter(F.col("o_orderkey") % 2 != 0)


@query("conditional_counts", """
SELECT count(*) AS n,
       count(*) FILTER (WHERE o_orderkey % 2 = 0) AS even,
       count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS odd,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS status_f,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS status_o,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS status_p
FROM orders
""")
def q_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return conditional_counts(_t(spark, d, "orders"), {
        "even": k % 2 == 0, "odd": k % 2 != 0,
        "status_f": s == "F", "status_o": s == "O", "status_p": s == "P"})


@query("format_stats", """
SELECT format('{:,}', count(*)) AS count_text, format('{:,.2f}', avg(o_totalprice)) AS mean_text
FROM orders
""")
def q_format_stats(spark: SparkSession, d: str) -> DataFrame:
    return format_stats(_t(spark, d, "orders"), "o_totalprice")


# ---------------------------------------------------------------- sources

@query("csv_infer_scan", "SELECT * FROM supplier")
def q_csv_infer_scan(spark: SparkSession, d: str) -> DataFrame:
    """Write supplier as a folder of CSV files (one header per file), read it
    back with header + type inference, cast to the declared schema."""
    supplier = _t(spark, d, "supplier")
    path = shared_dir(spark, "csv-supplier")
    supplier.write.option("header", "true").csv(path)
    spec = SourceSpec.from_config({"app": {"name": "csv-scan", "file": {"inputPath": path}}})
    raw = load_source(spark, spec)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in supplier.schema])


@query("csv_schema_scan", "SELECT * FROM supplier")
def q_csv_schema_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same CSV folder read with a declared schema: no inference pass,
    types come out right without casts."""
    supplier = _t(spark, d, "supplier")
    path = shared_dir(spark, "csv-supplier")
    supplier.write.option("header", "true").csv(path)
    spec = SourceSpec("csv", path, {"header": "true"}, supplier.schema)
    return load_source(spark, spec)


@query("configured_source", "SELECT * FROM nation")
def q_configured_source(spark: SparkSession, d: str) -> DataFrame:
    spec = SourceSpec.from_config({"app": {"name": "nation", "file": {
        "inputPath": f"{d.rstrip('/')}/nation.parquet", "format": "parquet"}}})
    return load_source(spark, spec)


@query("head_n", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def q_head_n(spark: SparkSession, d: str) -> DataFrame:
    return head_n(_t(spark, d, "customer"), 10, "c_custkey")


@query("describe_schema", """
SELECT position, column_name, data_type, nullable, CASE position
    WHEN 1 THEN (SELECT count(event_id) FROM events)
    WHEN 2 THEN (SELECT count(ts) FROM events)
    WHEN 3 THEN (SELECT count(user_id) FROM events)
    WHEN 4 THEN (SELECT count(event_type) FROM events)
    WHEN 5 THEN (SELECT count(value) FROM events)
    WHEN 6 THEN (SELECT count(props) FROM events) END AS non_null
FROM (VALUES
  (1, 'event_id', 'bigint', true),
  (2, 'ts', 'timestamp_ntz', true),
  (3, 'user_id', 'bigint', true),
  (4, 'event_type', 'string', true),
  (5, 'value', 'double', true),
  (6, 'props', 'string', true)) AS t(position, column_name, data_type, nullable)
""")
def q_describe_schema(spark: SparkSession, d: str) -> DataFrame:
    """The analyzed schema of events with the non-null count per column."""
    return describe_schema(_t(spark, d, "events"), count_values=True)


@query("catalog_roundtrip", """
SELECT r_regionkey, r_name FROM region
UNION ALL SELECT n_nationkey + 100, n_name FROM nation
""")
def q_catalog_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Create a table from region, append nation-derived rows, read it by
    name. Files live in the shared folder."""
    path = shared_dir(spark, "catalog-region")
    name = "tw_region_" + path.rsplit("-", 1)[-1]
    save_table(_t(spark, d, "region"), name, path=path)
    nation = _t(spark, d, "nation")
    append_table(nation.select((F.col("n_nationkey") + 100).alias("r_regionkey"),
                               F.col("n_name").alias("r_name")), name)
    result = read_catalog_table(spark, name)
    drop_table(spark, name)  # the name only: the files stay for the result
    return result


# ---------------------------------------------------------------- text

@query("word_count", r"""
SELECT word, count(*) AS n
FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents)
WHERE word <> '' GROUP BY word
""")
def q_word_count(spark: SparkSession, d: str) -> DataFrame:
    return word_count(_t(spark, d, "documents"), "text")


@query("split_explode", """
SELECT doc_id, unnest(generate_series(0, len(string_split(text, ',')) - 1)) AS pos,
       unnest(string_split(text, ',')) AS item
FROM documents
""")
def q_split_explode(spark: SparkSession, d: str) -> DataFrame:
    return split_explode(_t(spark, d, "documents"), "text", ",", keep=("doc_id",))


# ---------------------------------------------------------------- events

@query("decode_events", "SELECT * FROM events")
def q_decode_events(spark: SparkSession, d: str) -> DataFrame:
    """Events encoded as topic payloads (JSON text) and decoded back."""
    return decode_events(encode_events(_t(spark, d, "events")))


def _events_with_bad_values(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events")
    return ev.withColumn("value", F.when(F.col("event_id") % 17 == 0, -F.col("value"))
                         .otherwise(F.col("value")))


_TAGGED_EVENTS_SQL = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 17 = 0 THEN -value ELSE value END AS value, props
  FROM events),
t AS (
  SELECT *, CASE
      WHEN event_id IS NULL THEN 'missing_key'
      WHEN ts IS NULL THEN 'missing_ts'
      WHEN event_type IS NULL
        OR event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view') THEN 'unknown_type'
      WHEN value IS NULL OR value < 0 THEN 'bad_value'
      WHEN props IS NULL OR NOT json_valid(props) THEN 'bad_props'
    END AS reject_reason
  FROM e)
"""


@query("validate_events", _TAGGED_EVENTS_SQL + """
SELECT event_id, ts, user_id, event_type, value, props FROM t WHERE reject_reason IS NULL
""")
def q_validate_events(spark: SparkSession, d: str) -> DataFrame:
    return validated(_events_with_bad_values(spark, d))


@query("quarantine_events", _TAGGED_EVENTS_SQL + """
SELECT * FROM t WHERE reject_reason IS NOT NULL
""")
def q_quarantine_events(spark: SparkSession, d: str) -> DataFrame:
    return quarantined(_events_with_bad_values(spark, d))


@query("retention_filter", """
SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
""")
def q_retention_filter(spark: SparkSession, d: str) -> DataFrame:
    return retention_filter(_t(spark, d, "events"), "ts", 7)


# ---------------------------------------------------------------- filters

@query("filter_eq", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
def q_filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return filter_eq(_t(spark, d, "orders"), "o_orderstatus", None, default="O")


@query("filter_in", "SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P')")
def q_filter_in(spark: SparkSession, d: str) -> DataFrame:
    return filter_in(_t(spark, d, "orders"), "o_orderstatus", ["O", "P"])


@query("filter_not_contains", "SELECT * FROM orders WHERE NOT contains(o_orderpriority, 'URGENT')")
def q_filter_not_contains(spark: SparkSession, d: str) -> DataFrame:
    return filter_not_contains(_t(spark, d, "orders"), "o_orderpriority", "URGENT")


# ---------------------------------------------------------------- labels

def _event_labels(spark: SparkSession, d: str) -> DataFrame:
    """A label map per event, derived from props.k: spark-role, app name,
    another key, spark-role with an empty value, or no map at all."""
    ev = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    labels = (F.when(k == 0, F.create_map(F.lit("spark-role"), F.col("event_type")))
              .when(k == 1, F.create_map(F.lit("spark-app-name"),
                                         F.concat(F.lit("app-"), F.col("user_id").cast("string"))))
              .when(k == 2, F.create_map(F.lit("app"), F.col("event_type")))
              .when(k == 3, F.create_map(F.lit("spark-role"), F.lit(""))))
    return ev.select("event_id", labels.alias("labels"))


_CLASSIFY_SQL = """
WITH e AS (SELECT event_id, event_type, user_id,
                  CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS k FROM events),
m AS (SELECT event_id, CASE k
        WHEN 0 THEN MAP {'spark-role': event_type}
        WHEN 1 THEN MAP {'spark-app-name': 'app-' || CAST(user_id AS VARCHAR)}
        WHEN 2 THEN MAP {'app': event_type}
        WHEN 3 THEN MAP {'spark-role': ''}
        ELSE NULL END AS labels FROM e)
SELECT event_id,
       CASE WHEN coalesce(map_contains(labels, 'spark-role'), false)
              OR coalesce(map_contains(labels, 'spark-app-name'), false)
            THEN 'spark' ELSE 'infra' END AS class
FROM m
"""


@query("classify_by_key", _CLASSIFY_SQL)
def q_classify_by_key(spark: SparkSession, d: str) -> DataFrame:
    lab = _event_labels(spark, d)
    return lab.select("event_id", classify_by_keys("labels", SPARK_KEYS).alias("class"))


@query("union_all_parts", f"""
SELECT event_id, class, CASE class WHEN 'spark' THEN 0 ELSE 1 END AS part
FROM ({_CLASSIFY_SQL})
""")
def q_union_all_parts(spark: SparkSession, d: str) -> DataFrame:
    """'all' = the spark part followed by the infrastructure part, as one
    pass: every row with its part position."""
    return order_parts(q_classify_by_key(spark, d), "class", ["spark", "infra"])


@query("status_metrics", """
WITH tagged AS (
  SELECT true AS is_pod,
         lower(CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Running'
                    ELSE 'Pending' END) AS s,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_spark
  FROM orders
  UNION ALL
  SELECT false, upper(CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'O'
                           THEN 'running' ELSE 'COMPLETED' END), false
  FROM lineitem)
SELECT count(*) FILTER (WHERE is_pod) AS total_pods,
       count(*) FILTER (WHERE is_pod AND s = 'running') AS running_pods,
       count(*) FILTER (WHERE NOT is_pod AND s = 'RUNNING') AS active_apps,
       count(*) FILTER (WHERE is_pod AND s = 'failed')
         + count(*) FILTER (WHERE NOT is_pod AND s = 'FAILED') AS failed,
       count(*) FILTER (WHERE is_pod AND is_spark) AS spark_pods,
       count(*) FILTER (WHERE is_pod) - count(*) FILTER (WHERE is_pod AND is_spark) AS infra_pods,
       count(*) FILTER (WHERE NOT is_pod) AS total_apps
FROM tagged
""")
def q_status_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Orders play pods (status, labels); lineitems play applications."""
    orders = _t(spark, d, "orders")
    pods = orders.select(
        F.when(F.col("o_orderstatus") == "F", "Failed")
         .when(F.col("o_orderstatus") == "O", "Running").otherwise("Pending").alias("status"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
               F.create_map(F.lit("spark-role"), F.lit("driver")))
         .otherwise(F.create_map(F.lit("tier"), F.col("o_orderpriority"))).alias("labels"))
    li = _t(spark, d, "lineitem")
    apps = li.select(F.when(F.col("l_returnflag") == "R", "FAILED")
                     .when(F.col("l_linestatus") == "O", "running")
                     .otherwise("COMPLETED").alias("state"))
    return status_metrics(pods, apps)


def _raw_status(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    base = (F.when(F.col("o_orderstatus") == "F", "Succeeded")
            .when(F.col("o_orderstatus") == "O", "Running").otherwise("ContainerCreating"))
    raw = (F.when(k % 13 == 0, F.lit(None).cast("string")).when(k % 11 == 0, F.lit(""))
           .when(k % 7 == 0, F.lit("Error")).when(k % 5 == 0, F.lit("Evicted")).otherwise(base))
    return orders.select("o_orderkey", raw.alias("raw_status"))


@query("normalize_status", """
WITH s AS (SELECT o_orderkey, CASE
    WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN ''
    WHEN o_orderkey % 7 = 0 THEN 'Error' WHEN o_orderkey % 5 = 0 THEN 'Evicted'
    WHEN o_orderstatus = 'F' THEN 'Succeeded' WHEN o_orderstatus = 'O' THEN 'Running'
    ELSE 'ContainerCreating' END AS raw_status FROM orders),
classes(raw, cls) AS (VALUES ('running', 'running'), ('completed', 'completed'),
    ('succeeded', 'completed'), ('pending', 'pending'), ('containercreating', 'pending'),
    ('failed', 'failed'), ('error', 'failed'))
SELECT s.o_orderkey, coalesce(nullif(lower(s.raw_status), ''), 'unknown') AS status_text,
       coalesce(c.cls, 'unknown') AS status_class
FROM s LEFT JOIN classes c ON lower(coalesce(s.raw_status, '')) = c.raw
""")
def q_normalize_status(spark: SparkSession, d: str) -> DataFrame:
    s = _raw_status(_t(spark, d, "orders"))
    return s.select("o_orderkey", status_text("raw_status").alias("status_text"),
                    status_class("raw_status").alias("status_class"))


@query("lookup_default", """
WITH t AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL
                  ELSE ['Scala', 'Python', 'Java', 'Go'][p_size % 4 + 1] END AS app_type
           FROM part)
SELECT p_partkey, coalesce(nullif(app_type, ''), '—') AS type_shown,
       CASE app_type WHEN 'Scala' THEN 'scala' WHEN 'Python' THEN 'python'
                     WHEN 'Java' THEN 'java' ELSE 'unknown' END AS type_class
FROM t
""")
def q_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    kinds = F.array(*[F.lit(x) for x in ("Scala", "Python", "Java", "Go")])
    t = part.select("p_partkey", F.when(F.col("p_size") % 9 == 0, F.lit(None).cast("string"))
                    .otherwise(F.element_at(kinds, (F.col("p_size") % 4 + 1).cast("int")))
                    .alias("app_type"))
    return t.select("p_partkey", display_or_dash("app_type").alias("type_shown"),
                    lookup_default("app_type", TYPE_CLASSES).alias("type_class"))


@query("coalesce_labels", """
SELECT c_custkey, CASE c_custkey % 4
    WHEN 0 THEN coalesce(nullif(c_mktsegment, ''), nullif(c_name, ''), '—')
    WHEN 1 THEN coalesce(nullif(c_name, ''), '—')
    WHEN 2 THEN coalesce(nullif(c_mktsegment, ''), '—')
    ELSE '—' END AS label
FROM customer
""")
def q_coalesce_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label maps per customer: role + app; empty role + app; another key;
    empty map. Shown: spark-role, else app, else first value, else dash."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey") % 4
    labels = (F.when(k == 0, F.create_map(F.lit("spark-role"), F.col("c_mktsegment"),
                                          F.lit("app"), F.col("c_name")))
              .when(k == 1, F.create_map(F.lit("spark-role"), F.lit(""), F.lit("app"), F.col("c_name")))
              .when(k == 2, F.create_map(F.lit("x"), F.col("c_mktsegment")))
              .otherwise(F.create_map().cast("map<string,string>")))
    return c.select("c_custkey", first_label(labels, ["spark-role", "app"]).alias("label"))


# ---------------------------------------------------------------- time and JSON

def _events_with_null_ts(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events")
    return ev.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(None))
                     .otherwise(F.col("ts")).alias("ts"))


_NULL_TS_SQL = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS ts FROM events)
"""


@query("format_ts", _NULL_TS_SQL + """
SELECT event_id, coalesce(strftime(ts, '%d %b, %H:%M'), '—') AS shown FROM e
""")
def q_format_ts(spark: SparkSession, d: str) -> DataFrame:
    return _events_with_null_ts(spark, d).select("event_id", display_ts("ts").alias("shown"))


@query("iso_ts", _NULL_TS_SQL + """
SELECT event_id,
       strftime(ts, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END
         AS iso
FROM e
""")
def q_iso_ts(spark: SparkSession, d: str) -> DataFrame:
    return _events_with_null_ts(spark, d).select("event_id", iso_ts("ts").alias("iso"))


@query("flatten_json", """
WITH r AS (
  SELECT event_id, json_object(
      'metadata', json_object('name', 'app-' || CAST(event_id AS VARCHAR), 'namespace', 'spark'),
      'spec', json_object('type', CASE WHEN event_type = 'click' THEN NULL ELSE 'Python' END,
                          'image', 'img:' || event_type),
      'status', CASE event_type
          WHEN 'error' THEN json_object('applicationState',
                                        json_object('state', 'FAILED', 'errorMessage', 'k=' || json_extract_string(props, '$.k')))
          WHEN 'purchase' THEN json_object('applicationState', json_object('state', 'COMPLETED'))
          WHEN 'view' THEN json_object('other', 1)
          ELSE NULL END) AS doc
  FROM events)
SELECT event_id,
       doc->>'$.metadata.name' AS name,
       doc->>'$.metadata.namespace' AS namespace,
       coalesce(doc->>'$.status.applicationState.state', 'UNKNOWN') AS state,
       coalesce(doc->>'$.status.applicationState.errorMessage', '') AS message,
       doc->>'$.spec.type' AS type,
       doc->>'$.spec.image' AS image,
       doc->>'$.metadata.creationTimestamp' AS created
FROM r
""")
def q_flatten_json(spark: SparkSession, d: str) -> DataFrame:
    """Application records as JSON text (built from events, some parts
    missing), flattened with defaults."""
    ev = _t(spark, d, "events")
    et = F.col("event_type")
    # Each branch of the status has its own shape, so each is encoded alone.
    failed = F.to_json(F.struct(F.struct(
        F.lit("FAILED").alias("state"),
        F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("errorMessage"))
        .alias("applicationState")))
    completed = F.to_json(F.struct(F.struct(F.lit("COMPLETED").alias("state"))
                                   .alias("applicationState")))
    other = F.to_json(F.struct(F.lit(1).alias("other")))
    status_json = (F.when(et == "error", failed).when(et == "purchase", completed)
                   .when(et == "view", other))
    doc = F.concat(
        F.lit('{"metadata":'),
        F.to_json(F.struct(F.concat(F.lit("app-"), F.col("event_id").cast("string")).alias("name"),
                           F.lit("spark").alias("namespace"))),
        F.lit(',"spec":'),
        F.to_json(F.struct(F.when(et != "click", F.lit("Python")).alias("type"),
                           F.concat(F.lit("img:"), et).alias("image"))),
        F.coalesce(F.concat(F.lit(',"status":'), status_json), F.lit("")),
        F.lit("}"))
    flat = flatten_app_record(doc)
    return ev.select("event_id", flat.alias("r")).select("event_id", "r.*")


# ---------------------------------------------------------------- keyed relations

@query("tail_n_per_key", """
SELECT event_id, user_id, ts, CAST(recency AS INTEGER) AS recency FROM (
  SELECT event_id, user_id, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency
  FROM events) WHERE recency <= 5
""")
def q_tail_n_per_key(spark: SparkSession, d: str) -> DataFrame:
    ev = _t(spark, d, "events").select("event_id", "user_id", "ts")
    return tail_n_per_key(ev, "user_id", ["ts", "event_id"], 5)


@query("latest_by_key", """
SELECT event_id, ts, user_id, event_type, value, props, event_type AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def q_latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Records carry a label map, as the cluster's records do."""
    labelled = _t(spark, d, "events").withColumn("labels", F.create_map(F.lit("kind"), F.col("event_type")))
    latest = latest_by_key(labelled, "user_id", ["ts", "event_id"])
    return latest.withColumn("label", F.col("labels")["kind"]).drop("labels")


@query("rank_per_key", """
SELECT o_orderkey, o_custkey, o_totalprice,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn,
       CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk,
       CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS drk,
       CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS quartile
FROM orders
""")
def q_rank_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The ranking shape of ``sql_rank``: customers that fit a task by plain
    windows, larger ones by range slices, so no task holds too many rows."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return by_key_size(o, ["o_custkey"], rank_plain, rank_sliced)


def rank_plain(o: DataFrame) -> DataFrame:
    by_price = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    by_priority = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    over = {"rn": F.row_number().over(by_price), "rk": F.rank().over(by_priority), "drk": F.dense_rank().over(by_priority),
            "quartile": F.ntile(4).over(by_price)}
    return o.select("o_orderkey", "o_custkey", "o_totalprice", *[c.cast("bigint").alias(n) for n, c in over.items()])


def rank_sliced(o: DataFrame) -> DataFrame:
    by_price = ["o_totalprice", "o_orderkey"]
    numbered = row_number_within_key(o, "o_custkey", by_price, [False, True], out="rn",
                                     count_col="_cnt")
    tiled = numbered.withColumn("quartile", ntile_from("rn", "_cnt", 4)).drop("_cnt")
    ranked = rank_within_key(tiled, "o_custkey", ["o_orderpriority"], rank_col="rk",
                             dense_col="drk")
    return ranked.select("o_orderkey", "o_custkey", "o_totalprice", F.col("rn").cast("bigint").alias("rn"),
                         F.col("rk").cast("bigint").alias("rk"),
                         F.col("drk").cast("bigint").alias("drk"), "quartile")


@query("frames_per_key", """
WITH e AS (
  SELECT event_id, user_id, ts,
         CASE WHEN event_id % 7 = 0 OR user_id % 10 = 3 THEN NULL ELSE value END AS value
  FROM events)
SELECT event_id, user_id,
       lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value,
       lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event,
       CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS sum3,
       count(*) OVER (PARTITION BY user_id ORDER BY ts
            RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day
FROM e
""")
def q_frames_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The frame shape of ``sql_frames``: users that fit a task by plain
    windows, larger ones by range slices (lag, lead and a 3-row sum from one
    numbering plus one neighbour join; the 1-day RANGE count from a merged
    running count). Every seventh value and all values of every tenth user
    are NULL."""
    value = F.when((F.col("event_id") % 7 != 0) & (F.col("user_id") % 10 != 3), F.col("value"))
    ev = (_t(spark, d, "events").select("event_id", "user_id", "ts", value.alias("value"))
          .withColumn("_v", F.col("value").cast("decimal(18,2)")))
    return by_key_size(ev, ["user_id"], frames_plain, frames_sliced)


def frames_plain(ev: DataFrame) -> DataFrame:
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n_day = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
    return ev.select("event_id", "user_id", F.lag("value").over(by_time).alias("prev_value"),
                     F.lead("event_id").over(by_time).alias("next_event"),
                     F.sum("_v").over(by_time.rowsBetween(-2, Window.currentRow)).cast("double").alias("sum3"),
                     n_day.alias("n_day"))


def frames_sliced(ev: DataFrame) -> DataFrame:
    numbered = row_number_within_key(ev, "user_id", ["ts", "event_id"], out="_rn",
                                     weight="_v", weight_out="_run", weight_count="_k")
    near = neighbours_within_key(numbered, "user_id", "_rn", [
        ("value", -1, "prev_value"), ("event_id", 1, "next_event"), ("_run", -3, "_earlier"),
        ("_k", -3, "_ecount")])
    framed = near.withColumn("sum3", frame_sum("_run", "_k", "_earlier", "_ecount").cast("double"))
    counted = range_count_within_key(framed, "user_id", "ts", F.expr("INTERVAL 1 DAY"), "n_day")
    return counted.select("event_id", "user_id", "prev_value", "next_event", "sum3", "n_day")


def _active_customers(spark: SparkSession, d: str) -> DataFrame:
    """Keys with an open order: the desired set."""
    o = _t(spark, d, "orders")
    return o.filter(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("c_custkey"))


@query("stale_rows", """
SELECT * FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderstatus = 'O' AND o.o_custkey = c.c_custkey)
""")
def q_stale_rows(spark: SparkSession, d: str) -> DataFrame:
    return stale_rows(_t(spark, d, "customer"), _active_customers(spark, d), "c_custkey")


@query("dependent_rows", """
SELECT * FROM orders o WHERE o.o_orderstatus IN ('O', 'P') AND EXISTS (
  SELECT 1 FROM customer c WHERE c.c_acctbal > 0 AND c.c_custkey = o.o_custkey)
""")
def q_dependent_rows(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").filter(F.col("o_orderstatus").isin("O", "P"))
    parents = (_t(spark, d, "customer").filter(F.col("c_acctbal") > 0)
               .select(F.col("c_custkey").alias("o_custkey")))
    return dependent_rows(o, parents, "o_custkey")


_TARGET_NEW_SQL = """
WITH target AS (SELECT * FROM customer WHERE c_acctbal > 0),
new AS (SELECT * FROM customer c WHERE EXISTS (
          SELECT 1 FROM orders o WHERE o.o_orderstatus = 'O' AND o.o_custkey = c.c_custkey))
"""


@query("insert_if_absent", _TARGET_NEW_SQL + """
SELECT * FROM target
UNION ALL
SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.c_custkey = n.c_custkey)
""")
def q_insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    target = c.filter(F.col("c_acctbal") > 0)
    new = c.join(_active_customers(spark, d).distinct(), "c_custkey", "left_semi")
    return insert_if_absent(target, new, "c_custkey")


@query("reconcile", """
WITH desired AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'O'),
actual AS (SELECT DISTINCT c_custkey AS key FROM customer WHERE c_acctbal > 0)
SELECT coalesce(d.key, a.key) AS key,
       CASE WHEN a.key IS NULL THEN 'create' WHEN d.key IS NULL THEN 'delete' ELSE 'keep' END
         AS action
FROM desired d FULL OUTER JOIN actual a ON d.key = a.key
""")
def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Desired: customers with an open order. Actual: customers with a
    positive balance."""
    desired = _active_customers(spark, d).select(F.col("c_custkey").alias("key"))
    actual = (_t(spark, d, "customer").filter(F.col("c_acctbal") > 0)
              .select(F.col("c_custkey").alias("key")))
    return reconcile(desired, actual, "key")


@query("upsert_by_key", """
WITH updates AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 100 AS c_acctbal, c_mktsegment
  FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL
  SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment
  FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT *, c_mktsegment AS label FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.c_custkey = c.c_custkey)
UNION ALL SELECT *, c_mktsegment AS label FROM updates
""")
def q_upsert_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Changed rows (BUILDING balances + 100) and new rows (MACHINERY copies
    under new keys) merged into customer; records carry a label map."""
    c = _t(spark, d, "customer").withColumn("labels", F.create_map(F.lit("segment"), F.col("c_mktsegment")))
    changed = (c.filter(F.col("c_mktsegment") == "BUILDING")
               .withColumn("c_acctbal", F.col("c_acctbal") + 100))
    fresh = (c.filter(F.col("c_mktsegment") == "MACHINERY")
             .withColumn("c_custkey", F.col("c_custkey") + 1000000))
    merged = upsert_by_key(c, changed.unionByName(fresh), "c_custkey")
    return merged.withColumn("label", F.col("labels")["segment"]).drop("labels")


@query("delete_by_key", """
SELECT * FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderpriority = '1-URGENT' AND o.o_custkey = c.c_custkey)
""")
def q_delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Customers without those that have an urgent order."""
    urgent = (_t(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
              .select(F.col("o_custkey").alias("c_custkey")))
    return delete_by_key(_t(spark, d, "customer"), urgent, "c_custkey")


@query("range_join", """
SELECT a.event_id AS error_id, b.event_id, b.ts
FROM events a JOIN events b ON b.ts >= a.ts AND b.ts < a.ts + INTERVAL 10 MINUTE
WHERE a.event_type = 'error' AND b.event_type = 'purchase'
""")
def q_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of all users in the ten minutes after each error: no equal key."""
    ev = _t(spark, d, "events")
    errors = ev.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("error_id"), F.col("ts").alias("since"),
        (F.col("ts") + F.expr("INTERVAL 10 MINUTE")).alias("until"))
    bought = ev.filter(F.col("event_type") == "purchase").select("event_id", "ts")
    return range_join(bought, errors, "ts", "since", "until", 600).select("error_id", "event_id", "ts")


# ---------------------------------------------------------------- files and links

@query("prefix_concat", """
SELECT page_id, url, 's3a://pages/' || substr(url, 9) AS full_path
FROM pages WHERE starts_with(url, 'https://')
""")
def q_prefix_concat(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages").filter(F.startswith(F.col("url"), F.lit("https://")))
    return p.select("page_id", "url", F.concat(
        F.lit("s3a://pages/"), F.substring(F.col("url"), 9, 1 << 30)).alias("full_path"))


@query("suffix_allowlist", r"""
WITH f AS (SELECT p_partkey, p_name || ['.py', '.PY', '.jar', '.txt', '', '.tar.jar'][p_size % 6 + 1]
                  AS name FROM part),
x AS (SELECT p_partkey, name,
             lower(regexp_extract(string_split(name, '/')[-1], '^\.*[^.].*?(\.[^.]*)$', 1)) AS ext
      FROM f)
SELECT p_partkey, name, ext,
       CASE ext WHEN '.py' THEN 'text/x-python' ELSE 'application/octet-stream' END AS content_type
FROM x WHERE ext IN ('.py', '.jar')
""")
def q_suffix_allowlist(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    sfx = F.array(*[F.lit(x) for x in (".py", ".PY", ".jar", ".txt", "", ".tar.jar")])
    f = part.select("p_partkey", F.concat("p_name", F.element_at(
        sfx, (F.col("p_size") % 6 + 1).cast("int"))).alias("name"))
    x = f.withColumn("ext", file_extension("name"))
    return (x.filter(F.col("ext").isin(".py", ".jar"))
            .withColumn("content_type", content_type_for("ext")))


@query("rewrite_links", """
SELECT page_id, CASE page_id % 3 WHEN 2 THEN html ELSE replace(replace(replace(html,
         'href="/', 'href="/proxy/history/'),
         'src="/', 'src="/proxy/history/'),
         'action="/', 'action="/proxy/history/') END AS html
FROM pages
""")
def q_rewrite_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages sent as html, without a content type (read as html) and as plain
    text (left alone), by page."""
    kind = (F.when(F.col("page_id") % 3 == 0, F.lit("text/html; charset=utf-8"))
            .when(F.col("page_id") % 3 == 2, F.lit("text/plain")))
    p = _t(spark, d, "pages").withColumn("content_type", kind)
    return p.select("page_id", rewrite_links("html", "/proxy/history/", "content_type").alias("html"))


@query("derive_key", r"""
WITH n AS (SELECT s_suppkey,
    lower(replace(s_name, '#', '-')) || ['-driver', '-driver-driver', ''][s_suppkey % 3 + 1] AS name,
    CASE s_suppkey % 4 WHEN 0 THEN 'sel-' || CAST(s_suppkey AS VARCHAR) WHEN 1 THEN ''
         ELSE NULL END AS selector
  FROM supplier)
SELECT s_suppkey, name, coalesce(nullif(selector, ''), regexp_replace(name, '(?s)^(.*)-driver.*$', '\1'))
       AS app_key
FROM n
""")
def q_derive_key(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    sfx = F.array(F.lit("-driver"), F.lit("-driver-driver"), F.lit(""))
    k = F.col("s_suppkey")
    n = s.select("s_suppkey",
                 F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))),
                          F.element_at(sfx, (k % 3 + 1).cast("int"))).alias("name"),
                 F.when(k % 4 == 0, F.concat(F.lit("sel-"), k.cast("string")))
                  .when(k % 4 == 1, F.lit("")).alias("selector"))
    return n.select("s_suppkey", "name", derive_key("selector", "name").alias("app_key"))


@query("rollup_totals", r"""
WITH q AS (SELECT l_returnflag, l_linestatus,
                  CAST(CAST(l_quantity * 10 AS INTEGER) AS VARCHAR) || 'm' AS cpu,
                  CAST(l_linenumber * 128 AS VARCHAR) || 'Mi' AS memory FROM lineitem)
SELECT l_returnflag, l_linestatus,
       sum(CAST(regexp_extract(cpu, '^([0-9.]+)m$', 1) AS DOUBLE)) AS cpu_m,
       sum(CAST(regexp_extract(memory, '^([0-9.]+)Mi$', 1) AS DOUBLE)) AS mem_mi,
       CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS gid
FROM q GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def q_rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    """Resource quantities as text (``<n>m`` CPU, ``<n>Mi`` memory), parsed
    and totalled per flag pair with subtotals and a grand total."""
    li = _t(spark, d, "lineitem")
    q = li.select("l_returnflag", "l_linestatus",
                  F.concat((F.col("l_quantity") * 10).cast("int").cast("string"), F.lit("m")).alias("cpu"),
                  F.concat((F.col("l_linenumber") * 128).cast("string"), F.lit("Mi")).alias("memory"))
    return rollup_totals(q, ["l_returnflag", "l_linestatus"],
                         {"cpu_m": parse_cpu_millis("cpu"), "mem_mi": parse_mem_mib("memory")})

