import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidewater.llm.exact import drop_exact_copies, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [(5, "a b"), (3, "a  b"), (4, "a\tb"), (9, None), (8, ""), (7, " "), (1, "é"), (2, "long " * 30_000), (6, "long\n" * 30_000),
        (10, "a b "), (None, "a b"), (None, "q"), (None, "q"), (11, "z"), (11, "z")]


def check(df, rows):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()]
    assert sorted(got, key=str) == brute(rows)


def test_like_brute_force(frame):
    check(exact_groups(frame(ROWS)), ROWS)


def test_collisions_are_told_apart_by_bytes(frame):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, "text 3"), (None, "text 2")]
    check(exact_groups(frame(rows), key=lambda t: F.unhex(F.md5(F.substring(t, 1, 4)))), rows)


def test_empty_table(frame):
    assert exact_groups(frame([])).count() == 0


def test_stage_keeps_one_of_each(frame):
    docs = frame(ROWS)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, 7, 1, 2, 10, None, None, None, 11, 11], key=str)
