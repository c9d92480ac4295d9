"""SQL text run through ``run_sql`` over the registered tables: the shapes
an SQL-shell user writes. Each key has Spark SQL text and the DuckDB text of
the same query (they differ only where the dialects differ)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans.registry import query
from tidewater.plans.sql import run_script, run_sql
from tidewater.session import shared_dir
from tidewater.sources.catalog import drop_table


def _shape(name: str, spark_sql: str, duck_sql: str | None = None, settings: dict[str, str] | None = None):
    """Register SQL text; the oracle is the same text unless given.
    ``settings`` of the session hold while it runs."""
    @query(name, duck_sql if duck_sql is not None else spark_sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return run_sql(spark, spark_sql, d, settings=settings)
    run.__name__ = f"q_{name}"
    return run


_shape("sql_join_topk", """
SELECT c.c_custkey, c.c_name, n.n_name,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2))))
            AS DOUBLE) AS revenue
FROM customer c
JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderstatus = 'F'
GROUP BY c.c_custkey, c.c_name, n.n_name
ORDER BY revenue DESC, c.c_custkey
LIMIT 10
""")

_shape("sql_outer_join", """
WITH cs AS (SELECT c_nationkey AS nk, count(*) AS n_customers FROM customer
            WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY c_nationkey),
ss AS (SELECT s_nationkey AS nk, count(*) AS n_suppliers FROM supplier
       WHERE s_acctbal > 5000 GROUP BY s_nationkey)
SELECT coalesce(cs.nk, ss.nk) AS nationkey, n.n_name, r.r_name, cs.n_customers, ss.n_suppliers
FROM cs FULL OUTER JOIN ss ON cs.nk = ss.nk
LEFT JOIN nation n ON n.n_nationkey = coalesce(cs.nk, ss.nk)
RIGHT JOIN region r ON r.r_regionkey = n.n_regionkey
""")

_shape("sql_exists", """
SELECT c.c_custkey, c.c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
""")

_shape("sql_range_join", """
SELECT o.o_orderpriority, count(*) AS n_lines, count(DISTINCT o.o_orderkey) AS n_orders
FROM orders o JOIN lineitem l
  ON l.l_orderkey = o.o_orderkey
 AND l.l_shipdate >= o.o_orderdate
 AND l.l_shipdate < o.o_orderdate + INTERVAL 30 DAYS
GROUP BY o.o_orderpriority
""")

_shape("sql_scalar_subquery", """
SELECT c.c_custkey, c.c_nationkey, c.c_acctbal,
       (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders
FROM customer c
WHERE c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)
""")

_shape("sql_distinct", """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers,
       count(DISTINCT o_orderstatus) AS n_statuses, count(*) AS n
FROM orders GROUP BY o_orderpriority
""")

_shape("sql_select_distinct", """
SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem
""")

_shape("sql_cube", """
SELECT l_returnflag, l_linestatus,
       CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS gid,
       count(*) AS n, sum(l_quantity) AS qty
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")

_shape("sql_grouping_sets", """
SELECT o_orderstatus, o_orderpriority,
       CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS gid,
       count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())
""")

_shape("sql_having", """
SELECT o_custkey, count(*) AS n_orders,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_custkey
HAVING count(*) > 12
""")

_shape("sql_rank", """
SELECT o_orderkey, o_custkey, o_totalprice,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn,
       CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk,
       CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS drk,
       CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS quartile
FROM orders
""")

_shape("sql_frames", """
SELECT event_id, user_id,
       lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_value,
       lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event,
       CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS sum3,
       count(*) OVER (PARTITION BY user_id ORDER BY ts
            RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day
FROM events
""")

_shape("sql_setops", """
WITH f AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT 'union_all' AS op, count(*) AS n FROM (SELECT k FROM f UNION ALL SELECT k FROM p) t1
UNION ALL SELECT 'union', count(*) FROM (SELECT k FROM f UNION SELECT k FROM p) t2
UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM f INTERSECT SELECT k FROM p) t3
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM f EXCEPT SELECT k FROM p) t4
""")

_shape("sql_cte", """
WITH prio AS (SELECT * FROM (VALUES ('1-URGENT', 5), ('2-HIGH', 4), ('3-MEDIUM', 3),
                                    ('4-NOT SPECIFIED', 2), ('5-LOW', 1)) AS v(p, weight)),
big AS (SELECT o_custkey, o_orderpriority FROM orders
        WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))
SELECT b.o_custkey, CAST(sum(p.weight) AS BIGINT) AS score, count(*) AS n_big
FROM big b JOIN prio p ON b.o_orderpriority = p.p
GROUP BY b.o_custkey
""")

_shape("sql_sort_limit", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey
LIMIT 20 OFFSET 10
""")

_shape("sql_strings", r"""
SELECT p_partkey, upper(substring(p_name, 1, 5)) AS head, CAST(length(p_name) AS BIGINT) AS len,
       trim(concat('  ', p_brand, '  ')) AS brand, replace(p_type, 'A', 'a') AS type_a,
       regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no, lower(p_type) LIKE '%an%' AS has_an,
       lpad(CAST(p_size AS STRING), 3, '0') AS size_txt
FROM part
""")

_shape("sql_dates", """
SELECT o_orderkey,
       CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month_start,
       CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS yr,
       CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS qtr,
       CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days_left,
       CAST(o_orderdate + INTERVAL 45 DAYS AS DATE) AS due
FROM orders
""", """
SELECT o_orderkey,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS yr,
       CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS qtr,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS days_left,
       CAST(o_orderdate + INTERVAL 45 DAYS AS DATE) AS due
FROM orders
""")

_shape("sql_math", """
SELECT l_orderkey, l_linenumber,
       l_extendedprice * (1 - l_discount) AS net,
       abs(l_quantity - 25) AS dist,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k_floor,
       CAST(ceil(l_tax * 100) AS BIGINT) AS tax_pct,
       power(l_discount, 2) AS d2,
       (l_linenumber * 7) % 5 AS m,
       sqrt(l_quantity) AS sq,
       round(l_quantity / 7, 0) AS r0
FROM lineitem
""")

_shape("sql_nested", """
SELECT event_id,
       CAST(get_json_object(props, '$.k') AS INT) AS k,
       CAST(from_json(props, 'k INT').k * 2 AS INT) AS k2,
       CAST(size(split(event_type, 'i')) AS BIGINT) AS n_parts,
       map('type', event_type, 'user', CAST(user_id AS STRING))['type'] AS type_again,
       CAST(aggregate(transform(array(1, 2, 3), x -> x * CAST(get_json_object(props, '$.k') AS INT)),
                      0, (acc, x) -> acc + x) AS BIGINT) AS k6
FROM events
""", """
SELECT event_id,
       CAST(json_extract_string(props, '$.k') AS INT) AS k,
       CAST(CAST(json_extract(props, '$.k') AS INT) * 2 AS INT) AS k2,
       CAST(len(string_split(event_type, 'i')) AS BIGINT) AS n_parts,
       MAP {'type': event_type, 'user': CAST(user_id AS VARCHAR)}['type'] AS type_again,
       CAST(list_reduce(list_transform([1, 2, 3], lambda x: x * CAST(json_extract_string(props, '$.k') AS INT)),
                        lambda acc, x: acc + x) AS BIGINT) AS k6
FROM events
""")

_shape("sql_arrays", """
SELECT vec_id, label, CAST(size(embedding) AS BIGINT) AS dims,
       CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS n_pos,
       aggregate(embedding, CAST(0 AS DOUBLE), (acc, x) -> acc + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS sum_sq,
       CAST(embedding[0] AS DOUBLE) AS first_dim
FROM embeddings
""", """
SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dims,
       CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n_pos,
       list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))),
                   lambda acc, x: acc + x) AS sum_sq,
       CAST(embedding[1] AS DOUBLE) AS first_dim
FROM embeddings
""")


@query("sql_ctas", """
SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 2
UNION ALL
SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey >= 2
""")
def q_sql_ctas(spark: SparkSession, d: str) -> DataFrame:
    """CREATE TABLE AS SELECT, then INSERT INTO, then read, as SQL text. The
    table's files live in the shared folder."""
    path = shared_dir(spark, "ctas")
    name = "tw_ctas_" + path.rsplit("-", 1)[-1]
    result = run_script(spark, [
        f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS "
        "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 2",
        f"INSERT INTO {name} SELECT n_nationkey + 100, n_name, n_regionkey FROM nation "
        "WHERE n_regionkey >= 2",
        f"SELECT * FROM {name}",
    ], d)
    drop_table(spark, name)  # the name only: the files stay for the result
    return result


@query("sql_params", "SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000")
def q_sql_params(spark: SparkSession, d: str) -> DataFrame:
    """Named parameters bound by the engine, not pasted into the text."""
    return run_sql(spark, "SELECT * FROM orders WHERE o_orderstatus = :status "
                          "AND o_totalprice > :min_price", d,
                   args={"status": "P", "min_price": 1000})
