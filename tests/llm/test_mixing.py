import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import mixing, toxicity
from tidewater.llm.queries import DOMAIN, MIX

WEIGHTS = {"clean": 0.9, "junk": 0.1}


def rows_of(spark, p, n):
    return spark.createDataFrame([(i, int(k), [float(x) for x in q]) for i, (q, k) in enumerate(zip(p, n))],
                                 "doc_id long, n_tokens long, p array<double>").repartition(5)


def test_rates_reach_the_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.2, 0.3], 500)
    n = rng.integers(0, 900, 500)
    rows = rows_of(spark, p, n)
    moves, info = mixing.fit_rates(rows, [0.2, 0.5, 0.3], tolerance=1e-6)
    rate = {r.doc_id: r.rate for r in mixing.with_rates(rows, moves).collect()}
    rate = np.array([rate[i] for i in range(500)])
    assert (rate >= 0).all()
    total = (n[:, None] * p).sum()
    assert np.allclose((n * rate) @ p / total, [0.2, 0.5, 0.3], atol=2e-6)
    assert np.allclose(info["target"], np.array([0.2, 0.5, 0.3]) * total) and info["steps"] < mixing.STEPS
    # plain projected gradient on all rows at once comes to the same totals
    gram = (p * n[:, None]).T @ p
    scale = 1 / np.diag(gram)
    step = scale / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * gram * np.sqrt(scale)).max()
    r = np.ones(500)
    for _ in range(3000):
        r = np.maximum(0, r - p @ (((n * r) @ p - np.array([0.2, 0.5, 0.3]) * total) * step))
    assert np.allclose((n * r) @ p, (n * rate) @ p, rtol=1e-4)


def test_whole_domain_is_not_thinned(spark):
    rows = rows_of(spark, [[0.99, 0.01]] * 97 + [[0.02, 0.98]] * 3, [100] * 100)
    moves, _ = mixing.fit_rates(rows, [0.5, 0.5], whole=0, headroom=1.1)
    rate = {r.doc_id: r.rate for r in mixing.with_rates(rows, moves).collect()}
    assert min(rate[i] for i in range(97)) > 1
    assert rate[99] > 10


def test_no_likely_document_of_the_whole_domain_is_thinned(spark, caplog):
    rng = np.random.default_rng(5)
    clean = np.r_[rng.beta(40, 1, 900), rng.uniform(0.5, 0.7, 40), rng.beta(1, 20, 160)]
    rows = rows_of(spark, np.stack([clean, 1 - clean], axis=1), rng.integers(50, 500, 1100))
    with caplog.at_level("INFO", "tidewater.llm.mixing"):
        moves, info = mixing.fit_rates(rows, [0.95, 0.05], whole=0, headroom=1.1)
        got = mixing.with_rates(rows, moves, 0).toPandas()
        assert got[got.p.str[0] >= 0.5].rate.min() >= 1 and got.rate.min() < 1
        assert np.allclose(info["reached"], info["target"], atol=2e-4 * sum(info["target"])) and "reached" in caplog.messages[0]
        mixing.fit_rates(rows, [0.95, 0.05], whole=0, headroom=1.1, steps=1)
        assert "missed" in caplog.messages[1] and caplog.records[1].levelname == "WARNING"


def test_impossible_and_empty(spark):
    rows = rows_of(spark, [[1.0, 0.0]] * 10, [5] * 10)
    moves, info = mixing.fit_rates(rows, [0.5, 0.5])
    assert np.isfinite(info["reached"]).all()
    assert mixing.fit_rates(rows.limit(0), [0.5, 0.5])[0] == []


def test_copies_have_the_rates_as_mean(spark):
    df = spark.range(20_000).select("id", mixing.drawn_copies(F.lit(1.3), F.col("id")).alias("c"))
    counts = {r.c: r.n for r in df.groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {1, 2} and abs(counts[2] / 20_000 - 0.3) < 0.02


def test_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = mixing.mix(documents, labels, F.expr(DOMAIN), MIX).toPandas()
    p = got[["p_clean", "p_junk", "p_toxic"]].to_numpy()
    assert len(got) == documents.count() and np.allclose(p.sum(axis=1), 1) and (got.rate >= 0).all()
    truth = labels.withColumn("d", F.expr(DOMAIN)).toPandas().merge(got, on="doc_id")
    best = np.array(["clean", "junk", "toxic"])[truth[["p_clean", "p_junk", "p_toxic"]].to_numpy().argmax(axis=1)]
    assert (best == truth.d).mean() > 0.95
    assert (abs(got.copies - got.rate) < 1 + 1e-9).all()


def test_edge_rows(spark, frame):
    docs = frame([(i, "WOW!! BUY!!" if i % 3 == 0 else "a calm line of text") for i in range(60)]
                 + [(None, "a calm line"), (70, None), (71, ""), (72, "text " * 100_000), (1, "a calm line of text")])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(40)] + [(None, 1, 0), (41, None, 0)], "doc_id long, quality int, toxic int")
    mixed = mixing.mix(docs, labels, F.expr("case when quality = 0 then 'junk' when quality = 1 then 'clean' end"), WEIGHTS, whole="clean", headroom=1.1)
    assert mixed.count() == docs.count()
    out = mixing.resample(docs, mixed)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert {i for i in range(60) if i % 3} | {None, 72} <= kept
    assert mixing.resample(docs.limit(0), mixed).count() == 0
    same = mixing.mix(docs, labels.limit(0), F.lit("x"), WEIGHTS).collect()
    assert len({r.p_clean for r in same}) == 1


def test_samples_are_not_cut():
    assert mixing.DOMAIN_ROWS == 3_000 and toxicity.CLASS_ROWS == 6_000
