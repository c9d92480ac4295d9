"""SimHash near-duplicates by covering-code anchors.

A 64-bit fingerprint is cut into two pieces of 32 bits. Of at most five
differing bits, at most two lie in one of the pieces. In each piece the anchors
are the code words of the perfect Hamming code of length 31 (covering radius 1)
with the 32nd bit as it is. Two pieces at distance 2 or less have a midpoint
within distance 1 of both, and an anchor lies within 1 of the midpoint: both
fingerprints are copied to every anchor within distance 2 (at most 17 a piece)
and so meet at one of them, where all 64 bits are compared. The anchors number
2**27 a piece, so few unrelated fingerprints meet.

Only distinct fingerprints are copied, so equal documents cost one copy. An
anchor's fingerprints are linked by growing clusters, which gives at most one
link per fingerprint however many lie close together; anchors with very many
are compared slice against slice in tasks of bounded size. Links become
components by alternating star contraction, each round written to the shared
folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import remove, slices, text_of, written
from tidewater.operators.names import unused_name

#: Fingerprints of one anchor compared in one task; more are cut into slices.
HOT_ROWS = 20_000
#: Text bytes fingerprinted at once (a shingle takes 64 bytes meanwhile).
SLICE_BYTES = 2 << 20
#: Differing bits that two pieces of tolerance two are sure to cover.
MOST_BITS = 5


def fingerprint_bits(texts: list[bytes], shingle: int) -> np.ndarray:
    """The 64-bit fingerprint of each UTF-8 text."""
    from functools import partial

    from xxhash import xxh64_intdigest

    digest = partial(xxh64_intdigest, seed=42)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = ends[shingle - 1:] - 1 if len(words) >= shingle else ends[-1:] - 1
        first = np.r_[0, ends[:-shingle]] if len(words) >= shingle else np.zeros(1, np.int64)
        line = b" ".join(words)
        counts[i] = len(last)
        hashes.append(np.fromiter(map(digest, map(line.__getitem__, map(slice, first.tolist(), last.tolist()))),
                                  np.uint64, len(last)))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        n = counts[some]
        bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) for every row."""
    def run(batches):
        for b in batches:
            for i, j in slices(b.column(1), SLICE_BYTES):
                fp = fingerprint_bits(b.column(1).slice(i, j - i).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp.view(np.int64))],
                                                 names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def anchors(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, anchor) for every anchor within distance 2 of the 32-bit
    pieces. Bit i - 1 is position i of the Hamming code, bit 31 is free."""
    piece = piece.astype(np.int64)
    syndrome = np.zeros(len(piece), np.int64)
    for i in range(1, 32):
        syndrome ^= ((piece >> (i - 1)) & 1) * i
    bit = np.r_[0, 1 << np.arange(31)].astype(np.int64)  # by position; 0: no flip
    rows, found = [np.arange(len(piece))] * 2, [piece ^ bit[syndrome], piece ^ bit[syndrome] ^ (1 << 31)]
    off = np.flatnonzero(syndrome)
    for i in range(1, 32):
        # Two flips lead to a code word if their positions' xor is the syndrome.
        j = syndrome[off] ^ i
        two = off[j > i]
        rows.append(two)
        found.append(piece[two] ^ bit[i] ^ bit[syndrome[two] ^ i])
    return np.concatenate(rows), np.concatenate(found)


def clusters(fps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (first member, member) that connect all fingerprints of one
    group whose distance is at most ``most``, at most one per fingerprint."""
    links, rest = [], fps
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        todo = [seed]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= most
            if near.any():
                members = rest[near]
                links.append((np.full(len(members), seed), members))
                todo.extend(members)
                rest = rest[~near]
    return links


def group_links(keys: np.ndarray, fps: np.ndarray, most: int):
    """Links within groups of equal keys (keys sorted)."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    small = np.repeat(size <= 32, size)
    for lag in range(1, 32):
        at = np.flatnonzero(small[lag:] & (keys[lag:] == keys[:-lag])) if lag < len(keys) else []
        if not len(at):
            break
        at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= most]
        yield fps[at], fps[at + lag]
    for i in np.flatnonzero(size > 32):
        yield from clusters(fps[first[i]:first[i] + size[i]], most)


def link_batch(links, hot=()) -> pa.RecordBatch:
    """Links as smaller, larger; hot: (anchor, fingerprints) put off."""
    a, b = ([np.concatenate(x) for x in zip(*links)] if links else [np.zeros(0, np.uint64)] * 2)
    a, b = a.view(np.int64), b.view(np.int64)
    a, b = np.minimum(a, b), np.maximum(a, b)
    late = np.repeat([False, True], [len(a), sum(len(f) for _, f in hot)])
    a = np.concatenate([a, *(np.full(len(f), k, np.int64) for k, f in hot)])
    b = np.concatenate([b, *(f.view(np.int64) for _, f in hot)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(late)], names=["a", "b", "late"])


def fingerprint_links(distinct: DataFrame, most: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links a < b between distinct fingerprints ``fp`` that connect all pairs
    at ``most`` differing bits or fewer."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"max_bits must be 0 to {MOST_BITS}")

    def replicate(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for p in range(2):
                rows, anchor = anchors((fp >> np.uint64(32 * p)) & np.uint64(0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(anchor | p << 32), pa.array(fp[rows].view(np.int64))],
                                                 names=["anchor", "fp"])

    def compare(batches):
        keys, held = np.zeros(0, np.int64), []  # the last anchor's rows so far
        hot = None

        def done(k, f):
            return list(group_links(k, f, most))

        for b in batches:
            if not b.num_rows:
                continue
            k, f = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            if hot is not None:
                same = k == hot
                yield link_batch([], [(hot, f[same])])
                k, f = k[~same], f[~same]
                if not len(k):
                    continue
                hot = None
            k, f = np.concatenate([keys, k]), np.concatenate([*held, f])
            cut = np.searchsorted(k, k[-1])  # 0: all of one anchor
            if cut:
                groups_first = np.flatnonzero(np.r_[True, k[1:cut] != k[:cut - 1]])
                big = np.diff(np.r_[groups_first, cut]) > hot_rows
                put_off = [(k[x], f[:cut][k[:cut] == k[x]]) for x in groups_first[big]]
                if put_off:
                    yield link_batch([], put_off)
                stays = ~np.isin(k[:cut], k[groups_first[big]])
                yield link_batch(done(k[:cut][stays], f[:cut][stays]))
            keys, held = k[cut:], [f[cut:]]
            if len(keys) > hot_rows:
                hot = keys[0]
                yield link_batch([], [(hot, held[0])])
                keys, held = np.zeros(0, np.int64), []
        if len(keys):
            yield link_batch(done(keys, np.concatenate(held)))

    def compare_slices(pdf: pd.DataFrame) -> pd.DataFrame:
        b = link_batch(clusters(pdf["fp"].to_numpy().view(np.uint64), most))
        return b.select(["a", "b"]).to_pandas()

    meet = (distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
            .repartition("anchor").sortWithinPartitions("anchor")
            .mapInArrow(compare, "a long, b long, late boolean"))
    met = written(meet, "links")
    late = met.filter("late").select(F.col("a").alias("anchor"), F.col("b").alias("fp"))
    parts = late.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (late.join(parts, "anchor").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("anchor", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    sliced = dealt.groupBy("anchor", "i", "j").applyInPandas(compare_slices, "a long, b long")
    return met.filter("not late").select("a", "b").union(sliced).distinct()


def star_components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the links
    (a, b) but the roots, by alternating large and small stars.

    The least neighbours of each round are written before rows meet them: then
    both sides of these joins are plain shuffles, which adaptive execution
    splits where a node has a large share of the links."""
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .filter("a < b").distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "low")
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()
        # Every node with its smaller neighbours.
        large = written(large, "large")
        least = written(large.groupBy("b").agg(F.min("a").alias("low")), "least")
        small = (large.join(least, "b").filter("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
                 .union(least.select(F.col("low").alias("a"), "b")).distinct())
        done, edges = (edges, low, large, least), written(small, "edges")
        remove(edges.sparkSession, *done)  # no later round reads them
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Fingerprints link at ``max_bits`` or fewer differing bits (5 at most);
    component_id is the smallest id of all documents reachable over links.
    Null and empty texts have no words and the fingerprint zero, which links
    like any other. Rows with a null id take part in linking and get their
    component's id (null if no row there has one). Repeated rows are returned
    each. Other columns are not read. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    stars = star_components(fingerprint_links(nodes, max_bits, hot_rows))
    placed = (nodes.join(stars, F.col("fp") == F.col("node"), "left")
              .select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    # Only components of several fingerprints need their smallest id looked up.
    inner = stars.select("root").distinct()
    joint = (placed.join(inner, "root").groupBy("root").agg(F.min("rep").alias("component")))
    labels = (placed.join(joint, "root", "left")
              .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return (fps.join(labels, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 4, max_bits: int = 4,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of its smallest id.
    Rows without an id can't be named and stay."""
    name = unused_name("_gone", docs)
    gone = (near_duplicates(docs, shingle, max_bits, id_col, text_col)
            .filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
