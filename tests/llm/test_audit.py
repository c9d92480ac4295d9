"""The audit of filters against a brute-force version, row by row."""

import itertools
import re
from collections import Counter

import pytest
from llm_helpers import SF
from pyspark.sql import functions as F

from tidewater.llm.audit import audit, classes, measures, repeated
from tidewater.llm.queries import AUDIT, QUERIES

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def brute_force(docs, labels):
    """{(part, order, step): numbers} by applying each order to whole rows."""
    good = {r[0] for r in labels if r[1] == 1}
    toxic = {r[0] for r in labels if r[2] == 1}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and i > first[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            alive, dead = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[1]]
                redundant = sum(f in r[1] for r in dead)
                alive, dead = [r for r in alive if f not in r[1]], dead + gone
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), redundant, sum(r[1] == {f} for r in rows if r[0] == part),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: v + [shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def as_dict(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in [*COLUMNS, "shapley"]] for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (2, LONG, "en"),      # copies; a repeated row
    (4, "a " * 300, "en"), (5, LONG.upper(), "en"), (6, LONG + " #", "de"),  # one rule each
    (7, None, "en"), (8, "", "de"), (None, LONG, "en"), (None, "", "en"), (None, "", "en"),
    (9, "é" * 40 + "\u0085x y " * 200, "en"), (10, "x | y", ""), (10, "another text of the same id", ""),
]
LABELS = [(1, 1, 0), (2, 1, 1), (5, 1, 0), (5, 0, 1), (7, 0, 1), (None, 1, 1), (99, 1, 1)]


def frames(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = {c: F.lit(1) for c in ("t", "w", "digest", "part", "rows", "failed", "label_id", "before", "bit", "good")}
    return docs.withColumns(extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_equals_brute_force(spark):
    docs, labels = frames(spark, ROWS, LABELS)
    assert as_dict(audit(docs, labels, AUDIT)) == brute_force(ROWS, LABELS)


def test_documents_table(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = as_dict(QUERIES["op11_failing_id_audit"](spark, SF))
    assert len(got) == 600 * len({r[2] for r in rows})
    assert got == brute_force(rows, labels)


def test_empty_table(spark):
    docs, labels = frames(spark, [], [])
    assert audit(docs, labels, AUDIT).count() == 0


def test_other_rules(spark):
    """Any named conditions: two filters have two orders."""
    docs, labels = frames(spark, ROWS, LABELS)
    got = as_dict(audit(docs, labels, {"S": "n_chars < 10", "R": None}))
    assert {k[1] for k in got} == {"SR", "RS"}
    assert got["en", "RS", 1][1] == 2 and got["en", "RS", 2][1] == 3
    assert got["en", "SR", 1][1] == 3


def test_repeats_are_exact(spark):
    docs, _ = frames(spark, ROWS, LABELS)
    ids = sorted(r.doc_id for r in repeated(measures(docs)).select("doc_id").distinct().collect())
    assert ids == [2, 3, 8]


@pytest.mark.parametrize("relations", [0, 2])
def test_classes_keep_every_row(spark, relations):
    docs, _ = frames(spark, ROWS, LABELS)
    rows = measures(docs)
    found = classes(rows, [rows.filter("n_words < 200").select("doc_id", "digest")] * relations)
    assert found.agg(F.sum("rows")).first()[0] == len(ROWS)
    assert {r.failed for r in found.select("failed").distinct().collect()} <= {0, 3}
