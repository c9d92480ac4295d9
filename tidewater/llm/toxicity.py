"""Toxicity scores by FTRL-proximal logistic regression.

Features are the presence of hashed word n-grams (one and two words), of
skip-grams (two words with one or two words between) and of word beginnings
(four and six characters, alone and with the word's length, for inflected and
compound forms). Training runs in one task on
a bounded sample of labelled documents; L1 leaves few weights other than zero,
which go to all tasks as a compact list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import coded_words, distinct, hash_fraction, hashed, one_text, slices, text_of

#: Feature space: 2 to this power.
HASH_BITS = 20
#: Labelled documents of each class that training uses at most, on average.
CLASS_ROWS = 6_000
#: Text bytes whose features are made at once.
SLICE_BYTES = 3 << 19
ALPHA, BETA, L1, L2 = 0.4, 1.0, 5.0, 1.0
EPOCHS = 3
#: Lengths of word beginnings.
BEGINNINGS = (4, 6)
EDGES = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~¡¿«»…“”"
ODD = np.uint64(0x9E3779B97F4A7C15)


def bucket(x: np.ndarray) -> np.ndarray:
    return ((x * ODD) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (0 for one without letters or digits) and the buckets
    of its own features: the word, its beginnings, and those with its length."""
    bare = pc.utf8_trim(pc.utf8_lower(words), characters=EDGES)
    hashes = np.where(pc.equal(bare, "").to_numpy(zero_copy_only=False), 0, hashed(bare) | np.uint64(1)).astype(np.uint64)
    size = pc.utf8_length(bare).to_numpy().astype(np.uint64)
    begins = [hashed(pc.utf8_slice_codeunits(bare, 0, n)) + np.uint64(n) for n in BEGINNINGS]
    sized = [h + size * np.uint64(0x100000001B3) for h in begins]
    return hashes, np.stack([bucket(h) for h in (hashes, *begins, *sized)])


def features(texts: pa.Array, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of every present feature, once each, in
    order; with ``weights``, only of features whose weight is not zero."""
    flat = pc.replace_substring_regex(texts, r"[\t\n\v\f\r]", " ")
    words, codes, starts = coded_words(flat)
    hashes, own = word_features(words)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    real = hashes[codes] != 0
    codes, doc = codes[real], doc[real]
    h = hashes[codes]
    kept_docs, kept = [], []

    def keep(d, b):
        if weights is not None:
            some = np.flatnonzero(weights[b])
            d, b = d[some], b[some]
        kept_docs.append(d)
        kept.append(b)

    for row in own:
        if weights is not None:  # decided once per distinct word
            some = np.flatnonzero((weights[row] != 0)[codes])
            kept_docs.append(doc[some])
            kept.append(row[codes[some]])
        else:
            keep(doc, row[codes])
    for gap in (1, 2, 3):
        at = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.zeros(0, np.int64)
        pair = h[at] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * gap) + h[at + gap]
        keep(doc[at], bucket(pair))
    both = distinct(np.concatenate(kept_docs) << HASH_BITS | np.concatenate(kept))
    return both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over documents given as feature buckets; the last
    coordinate is the bias, without L1. Returns (weights, bias)."""
    size = (1 << HASH_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0
    order = np.random.default_rng(7)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, (np.sign(zi) * l1[i] - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = np.append(rows[k], size - 1)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - labels[k]
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", class_rows: int = CLASS_ROWS) -> dict:
    """Train on a repeatable sample of about ``class_rows`` labelled documents
    of each class; the log-odds are set right for the sampling.

    ``labels`` rows that are null, not 0 or 1, or not ``eligible`` (a condition
    on the id column) are left out. Without both classes the model is constant.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("y"),
                           eligible.alias("ok"))
             .filter("ok and label_id is not null and y in (0, 1)").select("label_id", "y").distinct())
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = known.filter(F.when(F.col("y") == 1, hash_fraction("label_id", counts.get(1, 0), class_rows))
                          .otherwise(hash_fraction("label_id", counts.get(0, 0), class_rows)))
    odds = (counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)
    sampled = (min(counts.get(1, 0), class_rows) + 0.5) / (min(counts.get(0, 0), class_rows) + 0.5)
    shift = float(np.log(odds / sampled))

    def learn(batches):
        rows, ys = [], []
        for b in batches:
            for i, j in slices(b.column(0), SLICE_BYTES):
                d, f = features(b.column(0).slice(i, j - i))
                rows += np.split(f.astype(np.int32), np.searchsorted(d, np.arange(1, j - i)))
            ys.append(b.column(1).to_numpy())
        y = np.concatenate(ys) if ys else np.zeros(0)
        if len(set(y.tolist())) < 2:
            w, bias = np.zeros(1 << HASH_BITS), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        else:
            w, bias = train(rows, y)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int32())),
                                          pa.array([w[at].tolist()], pa.list_(pa.float64())),
                                          pa.array([bias])], names=["at", "weight", "bias"])

    # The sample has a bounded number of (id, label) rows, so it can go to all tasks.
    sample = (docs.select(F.col(id_col).cast("long").alias("label_id"), text_of(text_col).alias("t"))
              .join(F.broadcast(chosen), "label_id"))
    model = (one_text(sample, "label_id", "y").repartition(1).sortWithinPartitions(F.xxhash64("label_id"), "t").select("t", "y")
             .mapInArrow(learn, "at array<int>, weight array<double>, bias double").collect())
    if not model:
        return {"at": [], "weight": [], "bias": 0.0}
    return {"at": model[0]["at"], "weight": model[0]["weight"], "bias": model[0]["bias"] + shift}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for every row. Null and empty texts get the score
    of a text without features. Null ids pass through, repeated rows are scored
    each, other columns are not read."""
    at, weight, bias = np.array(model["at"], np.int64), np.array(model["weight"]), model["bias"]

    def run(batches):
        w = np.zeros(1 << HASH_BITS)
        w[at] = weight
        for b in batches:
            for i, j in slices(b.column(1), SLICE_BYTES):
                d, f = features(b.column(1).slice(i, j - i), w)
                logit = bias + np.bincount(d, weights=w[f], minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.5, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more. Rows keep all
    their columns; the score is computed beside them in the same task."""
    at, weight, bias = np.array(model["at"], np.int64), np.array(model["weight"]), model["bias"]

    def run(batches):
        w = np.zeros(1 << HASH_BITS)
        w[at] = weight
        for b in batches:
            texts = pc.fill_null(b.column(b.schema.get_field_index(text_col)).cast(pa.string()), "")
            for i, j in slices(texts, SLICE_BYTES):
                d, f = features(texts.slice(i, j - i), w)
                logit = bias + np.bincount(d, weights=w[f], minlength=j - i)
                stays = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) < threshold
                yield b.slice(i, j - i).filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
