import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm.packing import WORD_PATTERN, ChunkEncoder, finish, pack, place
from tidewater.llm.tokens import ChunkCounter, count_tokens, load_merges

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = [" ", " ", "\n", "\t", "a", "B", "the", "ing", "'s", "1", "é", "é", "!", "<|endoftext|>", "aa", "w.***", "Straße",
         "J̌", "À", "\x1c", "\x85", "\xa0", "İ", "Σ", "ΟΣ", "\r", "\x00", "日本", "😀", "|", "<|", "ab" * 40]
texts = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def ours():
    return (ChunkCounter(load_merges(BYTES, public_tokenizers.PATTERN)),
            ChunkEncoder(WORDS, load_merges(WORDS, WORD_PATTERN)))


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=8))
def test_like_the_libraries(libraries, ours, many):
    a, b = ([e.ids for e in t.encode_batch(many, add_special_tokens=False)] for t in libraries)
    assert ours[0].count(pa.array(many)).tolist() == list(map(len, a))
    n, ids = ours[1].ids(pa.array(many))
    assert n.tolist() == list(map(len, b)) and ids.tolist() == sum(b, [])


def test_long_words(libraries):
    rng = random.Random(3)
    many = ["".join(rng.choices("abcdeth", k=20_000)), "a" * 5_000, " " * 300, "\n" * 50 + "x"]
    counter = ChunkCounter(load_merges(BYTES, public_tokenizers.PATTERN))
    assert counter.count(pa.array(many)).tolist() == [len(libraries[0].encode(t).ids) for t in many]


def test_counts(frame, documents, libraries):
    rows = [(1, None), (2, ""), (3, "one two"), (None, "x"), (3, "one two")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in
                  count_tokens(frame(rows), BYTES, public_tokenizers.PATTERN, limit=1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, True), (None, 1, 1, False), (3, 7, 2, True)], key=str)
    assert count_tokens(frame([]), BYTES, public_tokenizers.PATTERN).count() == 0
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents, BYTES, public_tokenizers.PATTERN).collect()}
    assert got == {r.doc_id: len(libraries[0].encode(r.text or "", add_special_tokens=False).ids) for r in documents.collect()}


def check_packed(rows, docs, library, capacity):
    import zlib
    from collections import defaultdict

    import numpy as np
    want = defaultdict(list)
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at:at + capacity]
            want[i].append((piece, at, len(cut), zlib.crc32(cut.tobytes())))
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing(frame, documents, libraries):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    used, least = check_packed(pack(documents, WORDS).collect(), docs, libraries[1], 2048)
    assert used <= least * 1.02 + 1
    odd = [(1, None), (2, ""), (None, "a b"), (3, "w " * 5000), (3, "w " * 5000), (4, "x " * 2047)]
    used, least = check_packed(pack(frame(odd), WORDS, shard_pieces=3).collect(), odd, libraries[1], 2048)
    assert pack(frame([]), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_places_fit(sizes):
    import numpy as np
    sizes = np.array(sizes, np.int64)
    bins, offsets = finish(sizes, *place(sizes, 50), 50)
    for b in set(bins.tolist()):
        mine = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist()))
        assert all(o == sum(s for _, s in mine[:k]) for k, (o, _) in enumerate(mine)) and sum(s for _, s in mine) <= 50


def test_sum_of_squares_rule():
    """Each piece goes where the sum of squared gap counts becomes smallest."""
    import numpy as np
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 20, 120)
    bins, offsets = place(sizes, 20)
    gaps = {}
    total = lambda g: sum(list(g.values()).count(x) ** 2 for x in range(1, 20))
    for k in np.argsort(-sizes, kind="stable"):
        options = []
        for b in [*gaps, len(gaps)]:
            gap = gaps.get(b, 20)
            if gap >= sizes[k]:
                options.append(total(gaps | {b: gap - sizes[k]}))
        gaps[bins[k]] = gaps.get(bins[k], 20) - sizes[k]
        assert total(gaps) == min(options)
