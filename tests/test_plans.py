"""Plan shape checks: pushdown, pruning, partial aggregation, no Python,
no cross joins."""

import pytest

from tidewater.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    skip = {"stream_bronze", "stream_running_agg", "stream_decode",
            "stream_validate", "csv_infer_scan", "catalog_roundtrip", "sql_ctas"}
    return {name: plan_of(fn(spark, SF)) for name, fn in QUERIES.items()
            if name not in skip}


def test_no_python_no_cross_join(plans):
    for name, plan in plans.items():
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                    "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_filters_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,O)]" in plans["filter_eq"]
    assert "In(o_orderstatus, [O,P])" in plans["filter_in"]


def test_columns_pruned(plans):
    # word count reads only the text column of documents
    assert "ReadSchema: struct<text:string>" in plans["word_count"]
    # reconcile reads key and filter columns only
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plans["reconcile"]


def test_partial_aggregation_before_shuffle(plans):
    for name, partial in (("word_count", "partial_count(1)"), ("group_sum_avg", "partial_sum("),
                          ("status_metrics", "partial_count("), ("latest_by_key", "partial_max_by(")):
        # read from the scan up, the partial aggregate comes before the exchange
        assert partial in plans[name].split("Exchange", 1)[1], name
    # distinct keys: one aggregate on each side of the exchange
    assert plans["stale_rows"].count("HashAggregate(keys=[c_custkey") == 2


def test_no_shuffle_of_whole_texts(plans):
    assert "RoundRobin" not in plans["word_count"]
    assert plans["word_count"].count("Exchange") == 1


def test_keyed_merges_read_each_input_once(plans):
    assert plans["upsert_by_key"].count("FileScan parquet") == 3  # the target, and two kinds of updates
    assert plans["reconcile"].count("FileScan parquet") == 2
    assert plans["insert_if_absent"].count("FileScan parquet") == 3  # target, new rows, their orders


def test_range_join_meets_in_buckets(plans):
    assert "_bucket" in plans["range_join"] and "Join" in plans["range_join"]

def test_top_n_per_key_limits_before_shuffle(plans):
    assert "WindowGroupLimit" in plans["tail_n_per_key"]


def test_one_aggregate_for_all_statistics(plans):
    assert plans["column_stats"].count("HashAggregate(keys=[]") == 2  # partial + final


def test_map_only_queries_stay_in_codegen(plans):
    """Column work compiles into one whole-stage-codegen stage over the scan."""
    for name in ("validate_events", "rewrite_links", "derive_key", "normalize_status",
                 "iso_ts", "suffix_allowlist", "parity_table"):
        plan = plans[name]
        assert "*(1)" in plan, name           # a codegen stage
        assert "Exchange" not in plan, name   # no shuffle for row-wise work
