"""Stages and operators on tables whose columns have the names that they use
inside, and on groups of copies that hold most of the rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import exact, mixing, packing, simhash
from tidewater.llm.quality import one_text

NAMES = """_gone _mix_id _mix_copies _mix_copy kept t k fp score deal sha rep n own_rep own_n texts id id_k keep_id group_size node root
    component component_id fingerprint a b low anchor late own other i j n_tokens p rate copies label_id y ok domain shard piece
    start length ids_crc32 sequence_id offset body words""".split()


@pytest.fixture
def clashing(spark):
    text = ["the dog runs over the hill and far away from here %d", "the dog runs over the hill"]
    rows = [(i, (text[0] % i if i % 3 else text[1]), "en", "s", 10) for i in range(40)] + [(None, text[1], None, None, None), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return docs.withColumns({n: F.lit(f"x{k}") for k, n in enumerate(NAMES)})


def test_stages_keep_clashing_columns(spark, clashing):
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, clashing, None)
        assert out.columns == clashing.columns
        rows = out.collect()
        assert 0 < len(rows) < clashing.count() and all(r[n] == f"x{k}" for r in rows for k, n in enumerate(NAMES))
    mixed = spark.createDataFrame([(i, 2 if i == 1 else 0 if i == 2 else 1) for i in range(40)], "doc_id long, copies int")
    out = mixing.resample(clashing, mixed)
    assert out.columns == clashing.columns
    got = [r.doc_id for r in out.collect()]
    assert got.count(1) == 2 and 2 not in got and got.count(None) == 1


def test_whole_pipeline_stages_on_clashing_columns(spark, clashing):
    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.drop_toxic(spark, clashing, sf)
    assert docs.columns == clashing.columns
    mixed = corpus_pipeline.mix_domains(spark, docs, sf)
    assert mixed.columns == clashing.columns
    assert corpus_pipeline.pack_sequences(spark, mixed, sf).count() >= 40


def test_equal_rows_without_an_id_fill_all_shards(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"))
    packed = packing.pack(docs.repartition(8), public_tokenizers.path("word_bpe_49k.json"), shard_pieces=100)
    shards = packed.groupBy(F.shiftright("sequence_id", 32).alias("s")).count().collect()
    assert len(shards) == 30 and max(r["count"] for r in shards) < 300
    assert packed.count() == 3000


def test_a_large_group_of_copies_is_many_keys(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 4 > 0, 'copy', concat('text ', id)) as text").repartition(8)
    groups = {}
    real = exact.written

    def keep(df, name):
        groups[name] = real(df, name)
        return groups[name]

    monkeypatch.setattr(exact, "written", keep)
    out = exact.exact_groups(docs)
    assert out.filter("not kept").count() == 2999 and out.filter("group_size = 3000 and keep_id = 1").count() == 3000
    assert groups["exact-groups"].count() > 500


def test_one_component_of_many_links(spark):
    """A star: one fingerprint with all links, and chains beside it."""
    links = [(0, i) for i in range(1, 2000)] + [(10_000 + i, 10_001 + i) for i in range(50)]
    found = simhash.star_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(1, 2000)} | {(10_001 + i, 10_000) for i in range(50)}


def test_a_repeated_id_is_one_row_of_a_sample(spark):
    rows = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 0, "a"), (2, 1, "c")], "label_id long, y int, t string")
    assert sorted(tuple(r) for r in one_text(rows, "label_id", "y").collect()) == [(1, 0, "a"), (2, 1, "c")]
