"""Interaction of document filters in every order of application.

One id table is stored per filter (its failing-id relation). Left-semi and
left-anti joins with these relations split the documents: a round per filter
divides every class of the round before into its members that are in the
relation and those that are not, so n filters take 2 n joins on narrow rows
instead of one pair of joins for each of the 2^n prefixes. After the last
round each prefix is a union of classes: its survivors are the classes left by
the anti-joins with all its relations, a filter's removals are those of them
taken by the semi-join with its own, and its redundancies are the classes
taken by its semi-join and by one of an earlier filter's. Counts of classes
(parts times 2^n rows) are all that the orders are computed from.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import remove, text_of, words_of, written

#: Columns that name one document here: rows equal in both share every verdict.
KEY = ["doc_id", "digest"]


def measures(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (doc_id, text, part) with the statistics that rules
    may use and the number of such rows (``rows``): n_words, n_distinct
    (distinct words), n_capitals (A-Z), n_chars (code points), n_signs (1 if a
    character of ``#$%&*|`` occurs). ``digest`` is the text's SHA-256."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                         text_of(text_col).alias("t"), words_of(text_col).alias("w"))
    stats = narrow.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"),
        F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"),
        (F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))).alias("n_capitals"),
        F.length("t").alias("n_chars"), F.col("t").rlike("[#$%&*|]").cast("int").alias("n_signs"))
    return stats.groupBy(*stats.columns).agg(F.count(F.lit(1)).alias("rows"))


def repeated(rows: DataFrame) -> DataFrame:
    """The rows whose text occurs under a smaller id: all but those of each
    text's smallest id. The anti-join is on (id, digest), which spreads evenly
    however many copies a text has. Rows without an id are never repeats."""
    named = rows.filter("doc_id is not null").select(*KEY)
    return named.join(named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), KEY, "left_anti")


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["digest"] == right["digest"])


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic (0 or 1). Several labels of one id count as
    one each; a row without an id has none (a key of its own keeps such rows
    from meeting in one task)."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    key = F.coalesce("doc_id", F.xxhash64("digest"))
    return (rows.join(marks, (key == F.col("label_id")) & F.col("doc_id").isNotNull(), "left").drop("label_id")
            .fillna(0, ["good", "toxic"]))


def classes(rows: DataFrame, relations: list[DataFrame]) -> DataFrame:
    """``rows`` with ``failed``: bit k is set where the row is in relation k.
    Each round is written, so later ones read it once however often they use it."""
    split = rows.withColumn("failed", F.lit(0))
    for k, relation in enumerate(relations):
        taken = split.join(relation, same_document(split, relation), "left_semi").withColumn("failed", F.col("failed") + (1 << k))
        left = split.join(relation, same_document(split, relation), "left_anti")
        before, split = split, written(taken.unionByName(left), f"audit-round-{k}")
        if k:
            remove(rows.sparkSession, before)
    return split


def audit(docs: DataFrame, labels: DataFrame, rules: dict[str, str | None], part_col: str = "lang",
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley for every order of ``rules`` in every part.

    ``rules`` maps one-letter names to a failure condition (SQL) on the columns
    of ``measures``, or to None for the repeats (``repeated``); null conditions
    don't fail. All n! orders are listed, so n is meant to be small (5 give 120).
    A part is a value of ``part_col``, null read as the empty string. Null text
    is empty. Repeated rows count each; rows without an id are judged by the
    other rules and have no label. Columns of ``docs`` other than the three
    named ones and of ``labels`` other than doc_id, quality and toxic are not
    read. An empty table has no parts and gives an empty result.
    """
    spark = docs.sparkSession
    names = list(rules)
    rows = written(measures(docs, part_col, id_col, text_col), "audit-measures")
    relations = [written(repeated(rows) if rule is None else rows.filter(rule).select(*KEY), f"audit-fails-{name}")
                 for name, rule in rules.items()]
    found = classes(labelled(rows.select(*KEY, "part", "rows"), labels), relations)
    counts = found.groupBy("part", "failed").agg(
        F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("good")).alias("n_good"), F.sum(F.col("rows") * F.col("toxic")).alias("n_toxic"))

    # (filters before, filter) decide a step's numbers: n 2^(n-1) pairs.
    bits = {name: 1 << k for k, name in enumerate(names)}
    orders = [("".join(order), step + 1, functools.reduce(operator.or_, (bits[x] for x in order[:step]), 0), bits[order[step]])
              for order in itertools.permutations(names) for step in range(len(names))]
    steps = spark.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    weight = {mask: math.factorial(mask.bit_count()) * math.factorial(len(names) - 1 - mask.bit_count())
              for mask in range(1 << len(names)) if mask.bit_count() < len(names)}
    pairs = [F.struct(F.lit(mask).alias("before"), F.lit(bit).alias("bit"), F.lit(w).cast("long").alias("orders"))
             for mask, w in weight.items() for bit in bits.values() if not mask & bit]
    f, before, bit = F.col("failed"), F.col("before"), F.col("bit")
    fails, earlier = f.bitwiseAND(bit) != 0, f.bitwiseAND(before) != 0

    def total(condition: Column, number: str) -> Column:
        return F.sum(F.when(condition, F.col(number)).otherwise(0)).cast("long")

    # A few dozen fixed pairs against a part's few classes: every class takes part in every pair.
    each = counts.select("*", F.inline(F.array(*pairs)))
    numbers = each.groupBy("part", "before", "bit", "orders").agg(
        total(~earlier & ~fails, "n").alias("kept"), total(~earlier & fails, "n").alias("removed"),
        total(earlier & fails, "n").alias("redundant"), total(f == bit, "n").alias("unique_fails"),
        total(~earlier & fails, "n_good").alias("good_lost"), total(~earlier & fails, "n_toxic").alias("toxic_lost"))
    numbers = written(numbers, "audit-numbers")
    shapley = numbers.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return (numbers.join(F.broadcast(steps), ["before", "bit"]).join(shapley, ["part", "bit"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
