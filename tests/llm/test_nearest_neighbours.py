import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.llm import quality
from tidewater.llm.queries import op10_nearest_neighbour_quality


def test_scores_like_all_neighbours(spark, documents):
    sf = "/root/testdata/sf0.001"
    model = quality.fit(documents, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True))
    y, basis = model["labels"], model["basis"].reshape(quality.TERMS, -1)
    vectors = model["vectors"].reshape(len(y), -1)
    rows = documents.collect()
    got = {r.doc_id: r.score for r in quality.score(documents, model, neighbours=9).collect()}
    z = quality.latent(quality.term_counts(pa.array([r.text for r in rows])), model["idf"], basis)
    for r, v in zip(rows, z):
        alike = [float(sum(a * b for a, b in zip(v.tolist(), w.tolist()))) for w in vectors]
        cut = sorted(alike)[-9]
        if sorted(alike)[-10] < cut - 1e-5:  # no tie at the edge
            near = [(max(a, 0), t) for a, t in zip(alike, y) if a >= cut]
            assert abs(got[r.doc_id] - sum(a * t for a, t in near) / sum(a for a, _ in near)) < 1e-3


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_nearest_neighbour_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97


def test_edge_rows(spark, frame):
    rows = ([(i, "THE!! BIG!! SALE!! NOW!!" if i % 2 else "the big dog sat on it.") for i in range(30)]
            + [(None, "THE!! SALE!!"), (50, None), (51, ""), (52, " \n"), (53, "a dog sat. " * 40_000), (1, "THE!! BIG!! SALE!! NOW!!")])
    docs = frame(rows)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(30)] + [(None, 1), (50, None), (60, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and by[1] < 0.5 < by[2] and by[None] < 0.5 < by[53]
    assert by[50] == by[51] == by[52] == float(np.float32(model["labels"].mean()))
    assert quality.score(frame([]), model).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}


def test_leading_directions_like_a_full_decomposition():
    rng = np.random.default_rng(3)
    w = (rng.normal(size=(300, 60)) * 0.8 ** np.arange(60)).astype(np.float32)
    got = quality.leading(w, 10)
    assert np.allclose(got.T @ got, np.eye(10), atol=1e-4)
    full = np.linalg.svd(w, full_matrices=False)[2][:10].T
    assert np.allclose(got @ got.T, full @ full.T, atol=1e-2)


def test_words_of_one_shape_are_different_terms():
    a, b, c = quality.term_counts(pa.array(["plain words here", "dreck texts junk", "plain words here"]))
    assert (a[:quality.WORDS] == quality.term_counts(pa.array(["other terms less"]))[0][:quality.WORDS]).all()
    assert (a == c).all() and (a[quality.WORDS:] != b[quality.WORDS:]).any()
    assert a[quality.WORDS:].sum() == 3


def test_votes_of_ties_have_no_order(spark, frame):
    """Thirty equal labelled documents, half of each label: all of them vote."""
    docs = frame([(i, "the very same text of every document") for i in range(30)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    assert {round(r.score, 6) for r in quality.score(docs, model, neighbours=5).collect()} == {0.5}
