"""Sum-of-squares packing of token sequences into fixed-size bins.

Tasks tokenize whole documents and emit one narrow row per piece. Pieces are
dealt by a hash into shards of a bounded number of pieces, so the work spreads
over the cluster however many documents there are; each shard keeps the number
of open bins per residual gap and puts every piece where the sum of the
squared numbers becomes smallest.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import coded_words, ragged, slices, text_of, written
from tidewater.llm.tokens import MergeTable, load_merges, surviving_symbols

#: Pieces a shard packs in one task, on average.
SHARD_PIECES = 100_000
#: Pre-token pattern of the word-end vocabulary (fixed value of its file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, by chunks.

    Only for vocabularies that lower-case texts and whose pre-tokens never
    contain or depend on white space: then a text's ids are those of its
    space-separated chunks in turn. Chunks of letters and ASCII marks are
    merged here, many at a time; all others are left to the library.
    """

    def __init__(self, path: str, table: MergeTable):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path).encode_batch
        self.table = table
        self.split = regex.compile("\\n|" + table.pattern).findall
        self.odd = regex.compile(r"[^\S\n]|[\x00-\x09\x0b-\x1f\x7f-\x9f]|\u03a3|<\|").search

    def plain(self, text: str) -> bool:
        """Lower-casing and splitting at \\n then give what the library gives:
        composed characters, no final-sigma rule, no special strings, no
        white space or control characters but \\n."""
        return is_normalized("NFC", text) and not self.odd(text) and is_normalized("NFC", text.lower())

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, all their ids in order)."""
        plain = np.ones(len(chunks), bool)
        if not self.plain("\n".join(chunks)):
            plain[:] = [self.plain(c) for c in chunks]
        odd = [e.ids for e in self.library(list(itertools.compress(chunks, ~plain)), add_special_tokens=False)]
        # All plain chunks at once: their pre-tokens, with \n after each chunk.
        flat = pa.array(self.split("\n".join([*itertools.compress(chunks, plain), ""]).lower()), pa.large_string())
        codes = pc.dictionary_encode(flat)
        distinct = codes.dictionary.to_pylist()
        counts, ids = surviving_symbols([b"" if p == "\n" else p.encode() for p in distinct], self.table)
        begins, at = np.cumsum(counts) - counts, codes.indices.to_numpy()
        number = counts[at]
        breaks = pc.equal(flat, "\n").to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(chunks), np.int64)
        lengths[plain] = np.diff(np.cumsum(number)[breaks], prepend=0)
        lengths[~plain] = list(map(len, odd))
        out = np.zeros(lengths.sum(), np.int32)
        mine = np.repeat(plain, lengths)
        out[mine] = ids[ragged(begins[at], number)]
        out[~mine] = [i for x in odd for i in x]
        return lengths, out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all their ids in order)."""
        words, codes, starts = coded_words(pc.replace_substring(texts, "\n", " "))
        lengths, ids = self.of_chunks(words.to_pylist())
        begins = np.cumsum(lengths) - lengths
        total = np.r_[0, np.cumsum(lengths[codes])]
        return np.diff(total[starts]), ids[ragged(begins[codes], lengths[codes])]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and one
    ``end_id``, cut into pieces of ``capacity`` ids (the last may be shorter)."""
    table = load_merges(vocabulary, WORD_PATTERN)

    def run(batches):
        encoder = ChunkEncoder(vocabulary, table)
        for b in batches:
            for i, j in slices(b.column(1)):
                n, ids = encoder.ids(b.column(1).slice(i, j - i))
                # One end id after each text's ids.
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                pieces = -(-n // capacity)
                piece = ragged(np.zeros(len(n), np.int64), pieces)
                first = np.repeat(np.cumsum(n) - n, pieces) + piece * capacity
                length = np.minimum(np.repeat(n, pieces) - piece * capacity, capacity)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(first.tolist(), (first + length).tolist())]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), pieces))),
                    pa.array(piece.astype(np.int32)), pa.array(piece * capacity),
                    pa.array(length), pa.array(crc, pa.int64()),
                ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size by the sum-of-squares rule, largest first.

    Putting size s into gap g changes the sum by -2 n[g] + 2 n[g - s] + 2 (by
    -2 n[s] + 1 where it fills the bin), a new bin changes it by
    2 n[capacity - s] + 1. Ties go to the smaller gap, then to an open bin.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    far, made = np.int64(1) << 40, 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[k])
        g = capacity
        if s < capacity:
            have = n[s:capacity]
            change = 2 - 2 * have
            change[1:] += 2 * n[1:capacity - s]
            change[0] -= 1
            change[have == 0] = far
            best = int(change.argmin())
            if change[best] <= 2 * n[capacity - s] + 1:
                g = s + best
        if g == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[g].pop()
            n[g] -= 1
        bins[k], offsets[k] = b, capacity - g
        if g > s:
            n[g - s] += 1
            open_bins[g - s].append(b)
    return bins, offsets


def finish(sizes: np.ndarray, bins: np.ndarray, offsets: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Take the bins that stayed open apart and pack their pieces best fit
    first, largest first, where that needs fewer bins."""
    used = np.bincount(bins, weights=sizes).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    loose = np.flatnonzero(used[bins] < capacity) if len(sizes) else np.zeros(0, np.int64)
    if not len(loose):
        return bins, offsets
    gaps: list[int] = []       # ascending (gap, new bin) as one number
    again, at, made = np.empty(len(loose), np.int64), np.empty(len(loose), np.int64), 0
    for k in np.argsort(-sizes[loose], kind="stable").tolist():
        s = int(sizes[loose[k]])
        i = bisect.bisect_left(gaps, s << 32)
        if i < len(gaps):
            g, b = gaps[i] >> 32, gaps[i] & 0xFFFFFFFF
            del gaps[i]
        else:
            g, b, made = capacity, made, made + 1
        again[k], at[k] = b, capacity - g
        if g > s:
            bisect.insort(gaps, (g - s) << 32 | b)
    if made >= (used < capacity).sum():
        return bins, offsets
    bins, offsets = bins.copy(), offsets.copy()
    bins[loose], offsets[loose] = again + len(used), at
    return np.unique(bins, return_inverse=True)[1], offsets


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with its sequence and its place there.

    Null text counts as empty: one piece that holds ``end_id`` alone. Repeated
    rows are packed each; null ids pass through. Columns other than the id and
    the text are not read. An empty table gives an empty result. The number of
    shards grows with the number of pieces; each leaves a few part-filled bins.
    """
    # A number per written row deals them: rows that are equal spread as well.
    rows = written(pieces_of(docs, vocabulary, capacity, end_id, id_col, text_col)
                   .withColumn("deal", F.monotonically_increasing_id()), "pieces")
    shards = -(-rows.count() // shard_pieces) or 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins, offsets = finish(sizes, *place(sizes, capacity), capacity)
        pdf["sequence_id"] = pdf["shard"].astype("int64") * 2**32 + bins
        pdf["offset"] = offsets
        return pdf.drop(columns=["shard", "deal"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, schema)
