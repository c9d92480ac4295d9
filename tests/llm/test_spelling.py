"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from llm_helpers import SF
from pyspark.sql import functions as F

from tidewater.llm.queries import QUERIES
from tidewater.llm.spelling import paths, variants, word_counts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least_length, least_count, every):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_force(words, factor=2):
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w, n in words.items():
        others = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, count[w], words[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


TEXT = "colour " * 9 + "color " * 20 + "Colors " * 3 + "colours " * 4 + "aabbb " * 3 + "aabb " * 9 + "aabbbb " * 5 + "abbbb " * 3
ROWS = [(1, TEXT), (2, None), (3, ""), (None, "color COLOR " * 2), (4, "éclair Éclair éclair éclairs éclairs éclairs " * 2),
        (4, "color naïve naive naive naïve naïve naive"), (5, "x" * 2000 + " " + "x" * 2000 + " " + "x" * 1999 + "y " + ("x" * 1999 + "y ") * 2)]
ROWS += [(6, "tests " * 3 + "tesst " * 3 + "testt " * 3 + "tets " * 3 + "teste " * 6 + "testes " * 12 + "testers " * 24)] * 2


@pytest.mark.parametrize("every", [None, 3, 97])
def test_equals_brute_force(spark, frame, every):
    docs = frame(ROWS).withColumns({c: F.lit(1) for c in ("word", "n", "id", "key", "path", "slice", "run", "up", "down")})
    got = as_dict(variants(docs, slip_every=every))
    assert got == brute_force(counted(ROWS, 5, 3, every))
    assert every or got["colour"][:2] == ("color", "color")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abÀé", min_size=1, max_size=5), max_size=60))
def test_any_words(spark, frame, words):
    rows = [(1, " ".join(words))]
    assert as_dict(variants(frame(rows), least_length=1, least_count=1)) == brute_force(counted(rows, 1, 1, None))


def test_empty_table(spark, frame):
    assert variants(frame([])).count() == 0
    assert variants(frame([(1, "a b c"), (2, None)])).count() == 0


@pytest.mark.parametrize("slices", [1, 7, 200])
def test_node_numbers(spark, documents, slices):
    """Equal numbers are equal prefixes, however the words are sliced; last
    numbers follow the order of words."""
    words = word_counts(documents, 1, 1, None).limit(3000).select(F.col("word").alias("key"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = paths(words, "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    number = {}
    for r in rows:
        assert len(r.path) == len(r.key) + 1
        for i, x in enumerate(r.path):
            assert number.setdefault(r.key[:i], x) == x
    assert len(set(number.values())) == len(number)
    assert [r.key for r in sorted(rows, key=lambda r: r.path[-1])] == sorted(r.key for r in rows)


def test_documents_table(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    words = counted(rows, 5, 3, 97)
    assert as_dict(QUERIES["op13_trie_pair_spelling"](spark, SF)) == brute_force(words)
