"""A corpus pipeline: toxic documents out, copies out, mixed to target weights
and packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet in the shared folder and rereads it as the next
one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import exact, mixing, packing, simhash, toxicity
from tidewater.llm.common import remove, scratch, table, written

#: Domains by the labelled table and their shares of the mixed tokens. Clean
#: tokens are never thinned: the others shrink against them.
DOMAIN = "case when quality = 0 then 'junk' when quality = 1 then 'clean' end"
WEIGHTS = {"clean": 0.95, "junk": 0.05}
HEADROOM = 1.1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. The model is trained on
    the labelled rows of the documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one of the smallest id stays."""
    return exact.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id stays."""
    return simhash.drop_near_copies(docs, shingle=4, max_bits=4)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say, so that expected tokens of
    clean and junk text match the weights; documents that are likeliest clean
    all stay. The classifier is trained on all labelled documents of ``sf_dir``."""
    mixed = mixing.mix(docs, table(spark, sf_dir, "labels"), F.expr(DOMAIN), WEIGHTS,
                       train_docs=table(spark, sf_dir, "documents"), whole="clean", headroom=HEADROOM)
    return mixing.resample(docs, mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces placed in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_domains),
    ("sum-of-squares packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage has written for itself, and the result
    of the one before, go as soon as its own result stands in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    last: list[str] = []
    for name, stage in STAGES:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove(spark, *last, *[p for p in made if p != docs.written_path])
        last = [docs.written_path]
    return docs


#: Classifier stages can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None
