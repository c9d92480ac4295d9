"""Every registered query against its DuckDB oracle on the small tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tidewater.sources.files import TABLES
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"
from tidewater.plans import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_contract_shape():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["type", "sum_number", "avg_doubled"]
    assert df.count() == 2


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    dcols = [c[0] for c in res.description]
    order = sorted(range(len(dcols)), key=lambda i: dcols[i])
    drows = [tuple(r[i] for i in order) for r in res.fetchall()]
    assert cols == [dcols[i] for i in order]
    assert len(srows) == len(drows)
    assert digest(srows) == digest(drows)
