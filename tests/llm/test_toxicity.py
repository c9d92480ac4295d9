import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm_helpers import SF, by_id
from tidewater.llm import toxicity
from tidewater.llm.common import crc_class
from tidewater.llm.queries import op3_toxicity


def test_features_are_those_of_the_words():
    d, f = toxicity.features(pa.array(["One two  one", "", "two, one!\ntwo", "*** x"]))
    sets = [set(f[d == i].tolist()) for i in range(4)]
    assert not sets[1]
    # words, beginnings and pairs once each, whatever the marks and the case
    one = set(toxicity.features(pa.array(["one"]))[1].tolist())
    two = set(toxicity.features(pa.array(["TWO?"]))[1].tolist())
    assert one | two <= sets[0] and one | two <= sets[2] and not (one & two)
    pair = toxicity.features(pa.array(["one two"]))[1].tolist()
    assert set(pair) <= sets[0] and not set(pair) - one - two <= set(toxicity.features(pa.array(["two one"]))[1].tolist())
    w = np.zeros(1 << toxicity.HASH_BITS)
    w[list(one)] = 1.0
    d, f = toxicity.features(pa.array(["One two  one"]), w)
    assert set(f.tolist()) == one


def test_training_like_the_formulas():
    rng = np.random.default_rng(0)
    rows = [rng.choice(40, rng.integers(1, 12), replace=False) for _ in range(60)]
    y = np.array([float(3 in r or 5 in r) for r in rows])
    w, bias = toxicity.train(rows, y, epochs=2)
    z, n, order = {}, {}, np.random.default_rng(7)
    last = 1 << toxicity.HASH_BITS

    def weight(i):
        l1 = 0 if i == last else toxicity.L1
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for k in order.permutation(len(rows)):
            at = [*rows[k].tolist(), last]
            ws = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y[k]
            for i in at:
                z[i] = z.get(i, 0) + g - (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / toxicity.ALPHA * ws[i]
                n[i] = n.get(i, 0) + g * g
    assert np.allclose([w[i] for i in range(40)], [weight(i) for i in range(40)]) and math.isclose(bias, weight(last))
    assert (w != 0).sum() < 40


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.8
    assert got[got.toxic == 0].predicted.mean() < 0.01


def test_edge_rows(spark, frame):
    rows = [(i, "you moron" if i % 2 else "a fine day") for i in range(40)] + [(None, "you moron"), (50, None), (51, ""), (52, "moron " * 50_000), (1, "you moron")]
    docs = frame(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (50, None), (51, 7), (60, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > 0.5 > by[2] and by[None] == by[1] and by[50] == by[51] and by[52] > 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(by[i] < 0.5 for i, _ in rows)
    assert toxicity.score(frame([]), model).count() == 0
    # no labels, or labels of one class: a constant score
    for few in (labels.limit(0), labels.filter("toxic = 0")):
        scores = {r.score for r in toxicity.score(docs, toxicity.fit(docs, few, F.lit(True))).collect()}
        assert len(scores) == 1
    nobody = toxicity.fit(docs, labels, crc_class("doc_id", 5) == 99)
    assert len({r.score for r in toxicity.score(docs, nobody).collect()}) == 1


def test_labels_are_no_inputs(spark):
    """Scores don't change with lang, source, ids of unlabelled rows or order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    other = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit("xx").alias("lang")).orderBy(F.desc("doc_id"))
    a, b = by_id(toxicity.score(docs, model)), by_id(toxicity.score(other, model))
    assert all(a[i].score == b[i + 10**6].score for i in a)
