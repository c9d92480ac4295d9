"""Token counts by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of many documents are held as one flat symbol array with a sequence
number per symbol. In each round every sequence finds its lowest-rank adjacent
pair and merges all its occurrences at once; a sequence without a mergeable
pair is finished and its surviving symbols are its tokens.
"""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import coded_words, slices, text_of

#: White space outside ASCII that may stand beside a space.
OTHER_SPACES = re.compile(r"[^\S\x00-\x7f]")
NONE = np.int32(2**31 - 1)


@dataclass
class MergeTable:
    """Merges of a byte-level BPE vocabulary as sorted pair keys."""

    byte_ids: np.ndarray   # symbol of each byte value
    last_ids: np.ndarray   # the same for the last byte of a pre-token
    keys: np.ndarray       # left * 2**20 + right, ascending
    ranks: np.ndarray
    merged: np.ndarray
    specials: tuple[str, ...]
    pattern: str


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE
    files: Latin-1 printable bytes stand for themselves, the other bytes for
    the code points from 256 on, in byte order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def load_merges(path: str, pattern: str) -> MergeTable:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    end = spec["model"]["end_of_word_suffix"] or ""
    left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
    right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
    out = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
    keys = (left << 20) | right
    order = np.argsort(keys)
    byte_ids, last_ids = (np.array([vocab[c + x] for c in byte_alphabet()], dtype=np.int32) for x in ("", end))
    return MergeTable(byte_ids, last_ids, keys[order], order.astype(np.int32), out[order],
                      tuple(t["content"] for t in spec["added_tokens"]), pattern)


def pair_ranks(left: np.ndarray, right: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of each pair (rank NONE where no merge exists)."""
    key = (left.astype(np.int64) << 20) | right
    at = np.minimum(np.searchsorted(table.keys, key), len(table.keys) - 1)
    return np.where(table.keys[at] == key, table.ranks[at], NONE), table.merged[at]


def first_ranks(raw: np.ndarray, last: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """``pair_ranks`` of neighbouring bytes, by a table of all 2 x 65,536 byte
    pairs (``last``: the right byte ends a pre-token)."""
    left = np.repeat(np.arange(256), 256)
    right = np.tile(np.arange(256), 256)
    inner = pair_ranks(table.byte_ids[left], table.byte_ids[right], table)
    final = pair_ranks(table.byte_ids[left], table.last_ids[right], table)
    pair = (last[1:].astype(np.int32) << 16) | (raw[:-1].astype(np.int32) << 8) | raw[1:]
    return tuple(np.concatenate(x)[pair] for x in zip(inner, final))


def surviving_symbols(pre_tokens: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of each pre-token, and all their ids in order."""
    lengths = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
    counts = lengths.copy()
    raw = np.frombuffer(b"".join(pre_tokens), np.uint8)
    sym = table.byte_ids[raw]
    ends = np.cumsum(lengths)[lengths > 0] - 1
    sym[ends] = table.last_ids[raw[ends]]
    seq = np.repeat(np.arange(len(pre_tokens), dtype=np.int32), lengths)
    finished = []
    # rank, out: of the pair that starts at each symbol.
    rank, out = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
    if len(sym) > 1:
        last = np.zeros(len(sym), bool)
        last[ends] = True
        rank[:-1], out[:-1] = first_ranks(raw, last, table)
        rank[:-1][seq[1:] != seq[:-1]] = NONE
    while len(sym):
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        size = np.diff(np.r_[first, len(seq)])
        lowest = np.minimum.reduceat(rank, first)
        done = lowest == NONE
        counts[seq[first[done]]] = size[done]
        hit = np.flatnonzero((rank == np.repeat(lowest, size)) & (rank != NONE))
        # In a run of overlapping occurrences (a a a) every second one merges.
        run = np.r_[True, np.diff(hit) != 1][:len(hit)]
        run[1:] |= seq[hit[1:]] != seq[hit[:-1]]
        began = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
        hit = hit[(hit - began) % 2 == 0]
        sym[hit] = out[hit]
        stays = ~np.repeat(done, size)
        finished.append((seq[~stays], sym[~stays]))
        stays[hit + 1] = False
        # Only the pairs at and before a merged symbol have changed.
        stale = np.zeros(len(sym) + 1, bool)
        stale[hit] = True
        stale[:-1] |= np.r_[stale[1:-1], False]
        back = np.flatnonzero(hit > 0)
        gone = hit[back][~stays[hit[back] - 1]] - 2
        stale[gone[gone >= 0]] = True
        sym, seq, rank, out, stale = sym[stays], seq[stays], rank[stays], out[stays], stale[:-1][stays]
        again = np.flatnonzero(stale)
        inner = again[again < len(sym) - 1]
        rank[again] = NONE
        new, symbol = pair_ranks(sym[inner], sym[inner + 1], table)
        new[seq[inner] != seq[inner + 1]] = NONE
        rank[inner], out[inner] = new, symbol
    if not finished:
        return counts, np.zeros(0, np.int32)
    of, ids = (np.concatenate(x) for x in zip(*finished))
    return counts, ids[np.argsort(of, kind="stable")]


class ChunkCounter:
    """Token counts of whole texts by their distinct chunks.

    Where a single space follows a non-space character, the pre-tokens on its
    two sides don't depend on each other, so a text is the sum of its chunks
    (" word"). Texts in which white space surrounds a space, or that hold a
    special string, are split by the vocabulary's pattern as a whole.
    """

    def __init__(self, table: MergeTable):
        import regex

        self.table = table
        self.split = regex.compile(table.pattern).findall
        self.tight = regex.compile(r" ?\S+").fullmatch
        self.whole = "|".join([r"\s \s", *map(regex.escape, table.specials)])
        self.special = regex.compile("(" + "|".join(map(regex.escape, table.specials)) + ")").split

    def of_chunks(self, chunks: list[str]) -> np.ndarray:
        """Number of tokens of each chunk."""
        # Chunks without white space inside are split together: between them a
        # line feed is a pre-token of its own.
        out = np.zeros(len(chunks), np.int64)
        tight = np.fromiter((self.tight(c) is not None for c in chunks), bool, len(chunks))
        pre = [self.split(c) for c, t in zip(chunks, tight) if not t]
        flat = self.split("\n".join([*itertools.compress(chunks, tight), ""]))
        mark = len(flat)
        for x in pre:
            flat += x
        if not flat:
            return out
        codes = pc.dictionary_encode(pa.array(flat, pa.large_string()))
        counts, _ = surviving_symbols([p.encode() for p in codes.dictionary.to_pylist()], self.table)
        number = counts[codes.indices.to_numpy()]
        breaks = pc.equal(pa.array(flat[:mark], pa.large_string()), "\n").to_numpy(zero_copy_only=False)
        number[:mark][breaks] = 0
        out[tight] = np.diff(np.cumsum(number[:mark])[breaks], prepend=0)
        ends = np.cumsum([len(x) for x in pre], dtype=np.int64)
        total = np.r_[0, np.cumsum(number[mark:])]
        out[~tight] = total[ends] - total[np.r_[0, ends[:-1]]] if len(ends) else 0
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        whole |= np.fromiter((not t.isascii() and OTHER_SPACES.search(t) is not None for t in texts.to_pylist()), bool, len(texts))
        for i in np.flatnonzero(whole):
            # Special strings are one token each and split the text.
            pieces = self.special(texts[int(i)].as_py())
            out[i] = len(pieces) // 2 + self.of_chunks(pieces[::2]).sum()
        rows = np.flatnonzero(~whole)
        words, codes, starts = coded_words(texts.take(pa.array(rows)))
        words = words.to_pylist()
        if not len(rows):
            return out
        # The first word of a text has no space before it.
        heads = np.zeros(len(codes), bool)
        heads[starts[:-1]] = True
        total = np.r_[0, np.cumsum(np.where(heads, 0, self.of_chunks([" " + w for w in words])[codes]))]
        out[rows] = np.diff(total[starts]) + self.of_chunks([words[c] for c in codes[heads]])
        return out


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file, ``pattern`` its
    pre-token pattern. Null and empty texts have 0 tokens. Repeated rows are
    counted each; null ids pass through; other columns are not read.
    """
    table = load_merges(vocabulary, pattern)

    def run(batches):
        counter = ChunkCounter(table)
        for b in batches:
            parts = [counter.count(b.column(1).slice(i, j - i)) for i, j in slices(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(np.concatenate(parts))], names=["doc_id", "n_bytes", "n_tokens"])

    t = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("t"),
                       F.octet_length(t).cast("long").alias("n_bytes"))
    return (rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
