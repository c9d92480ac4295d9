import os

from tidewater.session import shared_dir
from tidewater.sources import SourceSpec, file_inventory, load_source
from tidewater.sources.catalog import append_table, read_catalog_table, save_table


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def test_csv_dir(spark):
    d = _local(shared_dir(spark, "test-csv"))
    os.makedirs(d)
    with open(f"{d}/part1.csv", "w") as f:
        f.write("id,name,amount\n1,a,10\n2,,20\n")
    with open(f"{d}/part2.csv", "w") as f:
        f.write("id,name,amount\n3,c,2.5\n")
    spec = SourceSpec.from_config({"app": {"name": "t", "file": {"inputPath": d}}})
    df = load_source(spark, spec)
    types = dict(df.dtypes)
    assert types["amount"] == "double" and types["id"] == "int"
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [(1, "a", 10.0), (2, None, 20.0), (3, "c", 2.5)]  # no header rows as data


def test_csv_with_schema_skips_inference(spark):
    d = _local(shared_dir(spark, "test-csv2"))
    os.makedirs(d)
    with open(f"{d}/a.csv", "w") as f:
        f.write("id,name\n1,a\n")
    spec = SourceSpec("csv", d, {"header": "true"}, "id BIGINT, name STRING")
    assert load_source(spark, spec).dtypes == [("id", "bigint"), ("name", "string")]


def test_file_inventory_prefix(spark, sf_small):
    inv = file_inventory(spark, sf_small, prefix="e")
    names = sorted(r.name for r in inv.collect())
    assert names == ["embeddings.parquet", "events.parquet"]
    r = inv.filter("name = 'events.parquet'").collect()[0]
    assert r.size == os.path.getsize(f"{sf_small}/events.parquet")
    assert r.path.endswith("/events.parquet")
    assert r.lastModifiedIso.startswith(r.lastModified.strftime("%Y-%m-%dT%H:%M:%S"))
    with_uri = file_inventory(spark, sf_small, prefix="events", base_uri="s3a://bucket/")
    assert with_uri.collect()[0].uri == "s3a://bucket/events.parquet"


def test_catalog_roundtrip(spark):
    path = shared_dir(spark, "test-table")
    save_table(spark.createDataFrame([(1, "x")], "a int, b string"), "tw_test_tbl", path=path)
    append_table(spark.createDataFrame([("y", 2)], "b string, a int"), "tw_test_tbl")
    assert sorted(tuple(r) for r in read_catalog_table(spark, "tw_test_tbl").collect()) == \
        [(1, "x"), (2, "y")]
