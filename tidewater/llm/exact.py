"""Exact duplicates by content hash, with byte comparison inside groups.

Every step is a DataFrame expression. A document's white space runs become one
space; its 128-bit MD5 is the group key. Only narrow (id, hash) rows take part
in the grouping, pre-aggregated before the shuffle. Texts travel once more,
and only for documents whose hash occurs twice or more: grouped by hash and
whole text they are compared byte by byte, copies collapsing in each task
before the shuffle. Where one hash has several texts (a collision) each text
is a group of its own.

A group may hold a third of all rows. Written rows carry a number from 0 to
``DEALS`` - 1, and rows meet what is known of their group on (hash, number),
so a large group is that many keys of a join; a small one is as many as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, text_of, written
from tidewater.operators.names import unused_name

#: Keys that the rows of one group are dealt to in joins.
DEALS = 1024


def normal_text(col: str) -> Column:
    return F.regexp_replace(text_of(col), SPACES, " ")


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 key: Callable[[Column], Column] = md5_key) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. All empty texts are equal. ``keep_id`` is the
    smallest non-null id of the equal texts; a row with a null id is never the
    one that stays unless all ids of its group are null (keep_id null, kept
    true). Repeated rows of one id and text are counted in ``group_size`` and
    are all marked kept: the id names one document. Other columns of
    ``docs`` are not read. An empty table gives an empty result.

    ``key`` is the group hash (tests pass a weak one to force collisions).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal_text(text_col).alias("t"))
    narrow = written(rows.select("doc_id", key(F.col("t")).alias("k"), F.unhex(F.sha2("t", 256)).alias("sha"),
                                 F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(DEALS)).cast("int").alias("deal")), "exact")
    dealt = narrow.groupBy("k", "deal").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    whole = dealt.groupBy("k").agg(F.min("rep").alias("rep"), F.sum("n").alias("n")).filter("n > 1")
    groups = written(dealt.select("k", "deal").join(whole, "k"), "exact-groups")
    # Texts of the documents of such groups, found by id (rows without one by
    # their hash): ids spread evenly whatever the size of a group. One plan at
    # every size: a merge join.
    suspects = written(narrow.join(groups, ["k", "deal"]).select("doc_id", "k").distinct(), "exact-suspects")
    texts = (rows.select(F.col("doc_id").alias("id"), "t", F.when(F.col("doc_id").isNull(), key(F.col("t"))).alias("id_k"))
             .join(suspects.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id"))
                   & F.col("id_k").eqNullSafe(F.when(F.col("doc_id").isNull(), F.col("k"))))
             .filter(key(F.col("t")).eqNullSafe(F.col("k")))
             .select("doc_id", "k", "t"))
    # Copies collapse to one row per task before the shuffle, however many.
    variants = (texts.groupBy("k", "t").agg(F.min("doc_id").alias("own_rep"), F.count(F.lit(1)).alias("own_n"))
                .select("k", F.unhex(F.sha2("t", 256)).alias("sha"), "own_rep", "own_n"))
    collided = variants.groupBy("k").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("k")
    apart = variants.join(collided, "k").join(groups.select("k", "deal"), "k")
    out = narrow.join(groups, ["k", "deal"], "left").join(apart, ["k", "deal", "sha"], "left")
    keep = F.coalesce("own_rep", "rep", "doc_id")
    return out.select(
        "doc_id", keep.alias("keep_id"),
        F.coalesce("own_n", "n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep. Rows
    without an id can't be named and stay."""
    name = unused_name("_gone", docs)
    gone = (exact_groups(docs, id_col, text_col).filter("not kept and doc_id is not null")
            .select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
