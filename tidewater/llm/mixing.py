"""Mixing with soft domain membership.

A classifier trained on the labelled table gives every document a posterior
over the domains. Nonnegative rates (expected copies) are then fitted so that
the expected tokens of the domains match their targets: accelerated projected
gradient on the scaled squared differences. A step changes a document's rate
by its posterior times one number per domain, so a document's rate follows
from the list of those numbers. Every iteration is one pass over the written
posteriors that brings back two numbers per domain; no rates are stored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import coded_words, distinct, hash_fraction, hashed, one_text, repetition, shapes_of, slices, text_of, written
from tidewater.operators.names import unused_names
from tidewater.llm.toxicity import HASH_BITS, SLICE_BYTES, bucket, train, word_features

LOG = logging.getLogger(__name__)
#: Labelled documents of each domain that training uses at most, on average.
DOMAIN_ROWS = 3_000
#: Largest relative difference from a target at which the fit ends, and the
#: most steps it takes.
TOLERANCE, STEPS = 1e-4, 40


def domain_features(texts: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, bucket), once each, of every word, word beginning and
    word shape of the texts, and of the steps that their repetition reaches;
    with ``used``, only of buckets marked there. And the texts' word counts."""
    words, codes, starts = coded_words(pc.replace_substring_regex(texts, r"[\t\n\v\f\r]", " "))
    hashes, own = word_features(words)
    kinds = pc.dictionary_encode(pa.array(shapes_of(words), pa.string()))
    shapes = bucket(hashed(kinds.dictionary) + np.uint64(9))[kinds.indices.to_numpy()]
    bare, empty = hashes == 0, pc.equal(words, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pairs = []
    for row, skip in (*((r, bare) for r in own), (shapes, empty)):
        wanted = ~skip if used is None else ~skip & used[row]
        some = np.flatnonzero(wanted[codes])
        pairs.append(doc[some] << HASH_BITS | row[codes[some]])
    size = np.maximum(np.diff(starts), 1)
    for kind, number in enumerate(repetition(codes, starts)):
        for step in range(1, 11):
            reached = np.flatnonzero(10 * number >= step * size)
            pairs.append(reached << HASH_BITS | bucket(np.full(len(reached), (1 << 36) + 16 * kind + step, np.uint64)))
    both = distinct(np.concatenate(pairs))
    total = np.r_[0, np.cumsum(~empty[codes])]
    return both >> HASH_BITS, both & ((1 << HASH_BITS) - 1), np.diff(total[starts])


def fit_domains(docs: DataFrame, labels: DataFrame, domain: Column, domains: list[str], id_col: str = "doc_id",
                text_col: str = "text", domain_rows: int = DOMAIN_ROWS) -> list[dict]:
    """One model per domain (against the others), trained on a repeatable
    sample of about ``domain_rows`` labelled documents of each. ``domain`` is
    an expression over ``labels``; rows where it is null or no name in
    ``domains`` are left out."""
    known = (labels.select(F.col(id_col).cast("long").alias("label_id"), domain.alias("domain"))
             .filter(F.col("label_id").isNotNull() & F.col("domain").isin(domains)).distinct())
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    chosen = F.lit(False)
    for d in domains:
        chosen = F.when(F.col("domain") == d, hash_fraction("label_id", counts.get(d, 0), domain_rows)).otherwise(chosen)
    odds = {d: np.log((counts.get(d, 0) + 0.5) / (min(counts.get(d, 0), domain_rows) + 0.5)) for d in domains}

    def learn(batches):
        rows, names = [], []
        for b in batches:
            for i, j in slices(b.column(0), SLICE_BYTES):
                at, f, _ = domain_features(b.column(0).slice(i, j - i))
                rows += np.split(f.astype(np.int32), np.searchsorted(at, np.arange(1, j - i)))
            names += b.column(1).to_pylist()
        names = np.array(names, object)
        for d in domains:
            y = (names == d).astype(float)
            w, bias = train(rows, y) if 0 < y.sum() < len(y) else (np.zeros(1), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([at.tolist()], pa.list_(pa.int32())),
                                              pa.array([w[at].tolist()], pa.list_(pa.float64())), pa.array([bias])],
                                             names=["domain", "at", "weight", "bias"])

    # A bounded number of (id, domain) rows, so it can go to all tasks.
    sample = (docs.select(F.col(id_col).cast("long").alias("label_id"), text_of(text_col).alias("t"))
              .join(F.broadcast(known.filter(chosen)), "label_id"))
    found = {r["domain"]: r for r in
             one_text(sample, "label_id", "domain").repartition(1).sortWithinPartitions(F.xxhash64("label_id"), "t").select("t", "domain")
             .mapInArrow(learn, "domain string, at array<int>, weight array<double>, bias double").collect()}
    return [{"at": found[d]["at"], "weight": found[d]["weight"], "bias": found[d]["bias"] + odds[d]} if d in found
            else {"at": [], "weight": [], "bias": 0.0} for d in domains]


def posteriors(docs: DataFrame, models: list[dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (words), p (array of doubles that sum to 1, in the
    order of ``models``) for every row."""
    sparse = [(np.array(m["at"], np.int64), np.array(m["weight"]), m["bias"]) for m in models]

    def run(batches):
        w = np.zeros((1 << HASH_BITS, len(sparse)), np.float32)
        for k, (at, weight, _) in enumerate(sparse):
            w[at, k] = weight
        bias, used = np.array([b for _, _, b in sparse]), (w != 0).any(axis=1)
        for b in batches:
            for i, j in slices(b.column(1), SLICE_BYTES):
                d, f, n = domain_features(b.column(1).slice(i, j - i), used)
                logit = np.stack([np.bincount(d, weights=w[f, k], minlength=j - i) for k in range(len(sparse))], axis=1) + bias
                odds = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                p = odds / odds.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(p.tolist(), pa.list_(pa.float64()))],
                                                 names=["doc_id", "n_tokens", "p"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def replay(p: np.ndarray, moves: list[list[float]], whole: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents with posteriors ``p`` after the given steps from rate
    1, and the extrapolated rates at which the next step's slope is taken. The
    rate is 1 at least where ``whole`` is the likeliest domain."""
    rate = ahead = np.ones(len(p))
    least = 0.0 if whole is None else (p[:, whole] >= p.max(axis=1, initial=0.0)).astype(float)
    for k, move in enumerate(moves):
        before, rate = rate, np.maximum(least, ahead - p @ np.array(move))
        ahead = rate + (k + 1) / (k + 4) * (rate - before)
    return rate, ahead


def posterior_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def expected_tokens(rows: DataFrame, moves: list[list[float]], domains: int, whole: int | None = None) -> np.ndarray:
    """Expected tokens of each domain at the rates and at the extrapolated
    rates: each task adds up its own rows."""
    def sums(batches):
        for b in batches:
            if b.num_rows:
                p, n = posterior_matrix(b.column(1)), b.column(0).to_numpy()
                both = np.concatenate([(n * r) @ p for r in replay(p, moves, whole)])
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in both], names=[f"s{i}" for i in range(2 * domains)])

    parts = rows.select("n_tokens", "p").mapInArrow(sums, ", ".join(f"s{i} double" for i in range(2 * domains)))
    return np.array(parts.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(2 * domains)]).first()).reshape(2, domains)


def fit_rates(rows: DataFrame, weights: list[float], whole: int | None = None, headroom: float = 1.0,
              tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[list[list[float]], dict]:
    """Fit the rates of ``rows`` (n_tokens, p) to domain ``weights`` by
    accelerated projected gradient: (the steps taken, what was reached).

    The targets add up to the present number of tokens, or to as many more as
    let the domain numbered ``whole`` keep ``headroom`` times its tokens; no
    document whose likeliest domain it is gets a rate below 1, and the others
    are fitted around them. Targets that are not reached are logged.
    """
    k = len(weights)
    share = np.array(weights, float) / sum(weights)
    token = F.col("n_tokens").cast("double")
    gram = np.array(rows.agg(*[F.coalesce(F.sum(token * F.col("p")[i] * F.col("p")[j]), F.lit(0.0))
                               for i in range(k) for j in range(k)]).first()).reshape(k, k)
    have = gram.sum(axis=1)  # posteriors sum to 1
    total = have.sum()
    if whole is not None and share[whole] > 0:
        total = max(total, headroom * have[whole] / share[whole])
    target = share * total
    scale = 1 / np.maximum(np.diag(gram), 1.0)  # squared differences, scaled by domain
    root = np.sqrt(scale)
    curvature = max(float(np.linalg.eigvalsh(root[:, None] * gram * root).max()), 1e-12)
    moves: list[list[float]] = []
    ahead = have
    while len(moves) < steps and total > 0 and np.abs(have - target).max() > tolerance * total:
        moves.append(((ahead - target) * scale / curvature).tolist())
        have, ahead = expected_tokens(rows, moves, k, whole)
    missed = np.abs(have - target).max() > tolerance * total
    LOG.log(logging.WARNING if missed else logging.INFO, "targets %s after %d steps: expected tokens %s of %s",
            "missed" if missed else "reached", len(moves), have.round(1).tolist(), target.round(1).tolist())
    return moves, {"steps": len(moves), "target": target.tolist(), "reached": have.tolist()}


def with_rates(rows: DataFrame, moves: list[list[float]], whole: int | None = None) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                rate, _ = replay(posterior_matrix(b.column(2)), moves, whole)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rate)], names=["doc_id", "n_tokens", "p", "rate"])

    return rows.select("doc_id", "n_tokens", "p").mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double")


def drawn_copies(rate: Column, *seed: Column) -> Column:
    """A whole number of copies with expectation ``rate``, the same each time."""
    u = F.pmod(F.xxhash64(*seed, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], train_docs: DataFrame | None = None,
        whole: str | None = None, headroom: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, p_<domain> ..., rate, copies for every row of ``docs``.

    Null and empty texts have no tokens and a posterior by the classifier's
    bias. Null ids pass through, repeated rows are rated each (and alike),
    other columns are not read. Without usable labels all posteriors are equal.
    A domain without tokens can't reach its target; the others still do.
    """
    names = list(weights)
    models = fit_domains(docs if train_docs is None else train_docs, labels, domain, names, id_col, text_col)
    rows = written(posteriors(docs, models, id_col, text_col), "posteriors")
    kept = names.index(whole) if whole else None
    moves, _ = fit_rates(rows, [weights[d] for d in names], kept, headroom)
    return with_rates(rows, moves, kept).select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(names)],
                        "rate", drawn_copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def resample(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as many times as its copies say. A row without an
    id can't be looked up and stays once."""
    mix_id, mix_copies, copy = unused_names("_mix_id _mix_copies _mix_copy", docs)
    copies = (mixed.filter("doc_id is not null").groupBy(F.col("doc_id").alias(mix_id))
              .agg(F.max("copies").alias(mix_copies)))
    joined = docs.join(copies, F.col(id_col).cast("long") == F.col(mix_id), "left")
    times = F.coalesce(F.col(mix_copies), F.lit(1))
    return (joined.filter(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times)))
            .select(*[docs[c] for c in docs.columns]))
