"""Quality scores by nearest neighbours in a latent space.

A document's terms are its words, their shapes (letters as a or A, digits as
0), shapes of neighbouring words, word lengths and repetitions. Latent
semantic analysis of a bounded labelled sample (TF-IDF weights, truncated
singular value decomposition) gives each labelled document a short vector.
These vectors go to all tasks; each task compares blocks of its documents with
all of them by exact cosine products and lets the nearest vote, weighted by
similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import coded_words, hash_fraction, hashed, one_text, repetition, shapes_of, slices, text_of

#: Size of the term space, and of the latent space.
TERMS, LATENT = 2560, 48
#: Terms from here on are hashed words.
WORDS = 2048
#: Labelled documents of each class that are fitted and compared with, on average.
CLASS_ROWS = 2_000
NEIGHBOURS = 25
#: Documents of one block.
BLOCK = 1_500


def term_counts(texts: pa.Array) -> np.ndarray:
    """Number of occurrences of each hashed term, a row for each text."""
    words, codes, starts = coded_words(pc.replace_substring_regex(texts, r"[\t\n\v\f\r]", " "))
    rows = len(starts) - 1
    shapes = pc.dictionary_encode(pa.array(shapes_of(words), pa.string()))
    hashes = (hashed(shapes.dictionary) >> np.uint64(20)).astype(np.int64)
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(rows), np.diff(starts))
    stutter, again = repetition(codes, starts)
    real = length[codes] > 0
    doc, codes = doc[real], codes[real]
    h = hashes[shapes.indices.to_numpy()][codes]
    keys = [doc * TERMS + h % 900]
    if len(h) > 1:
        near = doc[1:] == doc[:-1]
        keys.append((doc[1:] * TERMS + 900 + (h[:-1] * 31 + h[1:] * 7) % 1000)[near])
    keys.append(doc * TERMS + 1900 + np.minimum(length[codes], 40))
    word = ((hashed(words) >> np.uint64(20)) % np.uint64(TERMS - WORDS)).astype(np.int64)
    keys.append(doc * TERMS + WORDS + word[codes])
    out = np.bincount(np.concatenate(keys), minlength=rows * TERMS).reshape(rows, TERMS).astype(np.float32)
    out[:, 1950], out[:, 1951] = 8 * stutter, 8 * again
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (all zero for a text without terms). A term's
    frequency is relative to the text's words, on a root scale."""
    x = np.sqrt(counts / np.maximum(counts[:, 1900:1950].sum(axis=1, keepdims=True), 1)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent(counts: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = weighted(counts, idf) @ basis
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def leading(w: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """The first ``k`` right singular vectors of ``w``, by subspace iteration
    from a fixed start with a few vectors more."""
    q = np.random.default_rng(7).normal(size=(w.shape[1], min(k + 16, w.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(w.T @ (w @ q))[0]
    values, turn = np.linalg.eigh((w @ q).T @ (w @ q))
    return (q @ turn[:, np.argsort(-values)[:k]]).astype(np.float32)


def blocks(texts: pa.Array):
    """(start, end) of blocks of a bounded number of texts and bytes."""
    for i, j in slices(texts):
        for s in range(i, j, BLOCK):
            yield s, min(j, s + BLOCK)


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", class_rows: int = CLASS_ROWS) -> dict:
    """Fit the latent space to a repeatable sample of about ``class_rows``
    labelled documents of each class. ``labels`` rows that are null, not 0 or
    1, or not ``eligible`` (a condition on the id column) are left out."""
    known = (labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("y"),
                           eligible.alias("ok"))
             .filter("ok and label_id is not null and y in (0, 1)").select("label_id", "y").distinct())
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = known.filter(F.when(F.col("y") == 1, hash_fraction("label_id", counts.get(1, 0), class_rows))
                          .otherwise(hash_fraction("label_id", counts.get(0, 0), class_rows)))

    def learn(batches):
        parts, ys = [], []
        for b in batches:
            parts += [term_counts(b.column(0).slice(i, j - i)) for i, j in blocks(b.column(0))]
            ys.append(b.column(1).to_numpy())
        if not parts:
            return
        x, y = np.concatenate(parts), np.concatenate(ys)
        idf = np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1)).astype(np.float32) + 1
        w = weighted(x, idf)
        basis = leading(w, LATENT)
        z = latent(x, idf, basis)
        yield pa.RecordBatch.from_arrays([pa.array([a.astype("<f4").tobytes()]) for a in (idf, basis, z, y)],
                                         names=["idf", "basis", "vectors", "labels"])

    # A bounded number of (id, label) rows, so it can go to all tasks.
    sample = (docs.select(F.col(id_col).cast("long").alias("label_id"), text_of(text_col).alias("t"))
              .join(F.broadcast(chosen), "label_id"))
    model = (one_text(sample, "label_id", "y").repartition(1).sortWithinPartitions(F.xxhash64("label_id"), "t").select("t", "y")
             .mapInArrow(learn, "idf binary, basis binary, vectors binary, labels binary").collect())
    return {k: np.frombuffer(v, "<f4") for k, v in model[0].asDict().items()} if model else {}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score (0 to 1) for every row. A text without words is like no
    other and gets the share of label 1 in the sample; so does every text if
    nothing was labelled (0.5). Null ids pass through, repeated rows are scored
    each, other columns are not read."""
    def run(batches):
        if model:
            idf, y = model["idf"], model["labels"]
            basis, vectors = model["basis"].reshape(TERMS, -1), model["vectors"].reshape(len(y), -1)
            prior = float(y.mean())
        for b in batches:
            for i, j in blocks(b.column(1)):
                if not model:
                    s = np.full(j - i, 0.5)
                else:
                    z = latent(term_counts(b.column(1).slice(i, j - i)), idf, basis)
                    alike = z @ vectors.T
                    k = min(neighbours, len(y))
                    # All that are as near as the k-th vote, so ties have no order.
                    kth = -np.partition(-alike, k - 1, axis=1)[:, k - 1:k]
                    vote = np.where(alike >= kth, np.maximum(alike, 0), 0).astype(np.float64)
                    total = vote.sum(axis=1)
                    s = np.where(total > 1e-6, vote @ y / np.maximum(total, 1e-6), prior)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.clip(s, 0, 1))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double")
