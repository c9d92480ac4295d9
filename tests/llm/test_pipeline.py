import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_simhash import brute_fingerprint, components, near
from test_tokens import check_packed
from tidewater.llm import toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_like_brute_force(spark):
    """Each stage against a plain-Python version over what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k in stages] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing to target weights", "sum-of-squares packing"]

    clean = stages["toxicity"](spark, docs, SF).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    before, kept = rows(docs), rows(clean)
    assert kept == {i: t for i, t in before.items() if scores[i] < 0.5} and clean.columns == docs.columns

    single = stages["exact dedup"](spark, clean, SF).cache()
    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert rows(single) == {i: kept[i] for i in first.values()} and single.columns == docs.columns

    apart = stages["simhash near-dedup"](spark, single, SF).cache()
    fps = {i: brute_fingerprint(t) for i, t in rows(single).items()}
    distinct = sorted(set(fps.values()))
    root, smallest = components(distinct, near(distinct, 4)), {}
    for i, x in sorted(fps.items()):
        smallest.setdefault(root[x], i)
    assert sorted(rows(apart)) == sorted(smallest.values()) and apart.columns == docs.columns

    mixed = stages["mixing to target weights"](spark, apart, SF).cache()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    counts = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(counts) <= set(smallest.values())
    assert all(counts[i] >= 1 for i in smallest.values() if i in labels and labels[i].quality == 1)
    assert all(rows(apart)[r.doc_id] == r.text for r in mixed.collect())

    packed = stages["sum-of-squares packing"](spark, mixed, SF)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    used, least = check_packed(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()], library, 2048)
    assert used <= least + 2


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100


def test_registered_queries():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
