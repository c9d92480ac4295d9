"""Groups of spelling variants by pairs of trie nodes.

Every prefix of a word is a node of the forward trie of all words, every
suffix one of the trie of the reversed words. With the nodes numbered, a word
without its character i is the integer pair (prefix before i, suffix after i),
and a word with a place to insert at i the pair (prefix before i, suffix from
i). Two words differ by a replacement where they have a skip pair in common,
and by an inserted or deleted character where a skip pair of one is an insert
pair of the other. The numbers are those of trie nodes, not hashes, so equal
pairs are equal strings and nothing is left to verify.

Words that share a skip pair differ in one character there, so a group of
equal pairs is never larger than the alphabet, and an insert pair belongs to
one word. Each group gives a number of neighbours and the best of them per
member, not pairs of members.

Numbering. Distinct words are sorted into range slices. A word of length L owns
the L + 1 numbers after those of the words before it and gives number i of
them to its prefix of length i, unless an earlier word has that prefix: then
it is that word's number. Slices number by themselves; the only nodes that two
slices share are prefixes of a slice's first word, which a walk over the
slices' first and last words (one row each) makes equal.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidewater.llm.common import remove, text_of, written

#: Letters of words; upper-case letters outside ASCII stay as they are.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
NUMBERED = [StructField("slice", IntegerType()), StructField("path", ArrayType(LongType()))]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(word: Column, doc_id: Column, every: int) -> Column:
    """``word`` without one character in one of about ``every`` (document,
    word) pairs: a repeatable slip, chosen and placed by their CRC-32. A null
    id counts as an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def word_counts(docs: DataFrame, least_length: int, least_count: int, slip_every: int | None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters of all texts with A-Z lower-cased, counted in
    each task before the shuffle. ``slip_every`` None leaves words as they are."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text_of(text_col), F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    low = runs.select("doc_id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("word"))
    words = low if slip_every is None else low.select(slipped(F.col("word"), F.col("doc_id"), slip_every).alias("word"))
    return (words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_count))


def paths(words: DataFrame, name: str) -> DataFrame:
    """``words`` (distinct, column ``key``, others kept) with ``path``: the
    numbers of the trie nodes of key's prefixes, from the empty one to the whole.

    The last number of a path grows with the key, in code-point order.
    """
    kept = words.columns
    at = kept.index("key")

    def number(batches):
        part, path, prev, total = TaskContext.get().partitionId(), [], None, 0
        for b in batches:
            out = []
            for key in b.column(at).to_pylist():
                same = 0
                if prev is not None:
                    same = 1
                    for x, y in zip(prev, key):
                        if x != y:
                            break
                        same += 1
                path = path[:same] + list(range(total + same, total + len(key) + 1))
                total += len(key) + 1
                prev = key
                out.append(path)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(out), pa.int32()), pa.array(out, pa.list_(pa.int64()))],
                                             names=[*kept, "slice", "path"])

    ordered = words.repartitionByRange("key").sortWithinPartitions("key")
    local = written(ordered.mapInArrow(number, StructType([*words.schema, *NUMBERED])), f"trie-{name}")
    # One row per slice: its first word, its last word with the path, its numbers.
    ends = local.groupBy("slice").agg(F.min("key").alias("first"), F.max(F.struct("key", "path")).alias("last"),
                                      F.sum(F.size("path")).alias("numbers")).orderBy("first").collect()
    base, above, before, moves = 0, [], "", []
    for r in ends:
        shared = 0
        while shared < min(len(before), len(r.first)) and before[shared] == r.first[shared]:
            shared += 1
        # Numbers of prefixes that the slice before has too: those given there.
        carry = above[:shared + 1]
        moves.append((r.slice, base, carry))
        above = [carry[x] if x < len(carry) else base + x for x in r.last.path]
        before, base = r.last.key, base + r.numbers
    table = words.sparkSession.createDataFrame(moves, "slice int, base long, carry array<long>")
    x = F.transform("path", lambda p: F.when(p < F.size("carry"), F.get("carry", p.cast("int"))).otherwise(F.col("base") + p))
    return local.join(F.broadcast(table), "slice").select(*kept, x.alias("path"))


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near, best (struct of n and minus id of the neighbour of largest n,
    ties to the smaller id) of each row of ``words`` (id, word, n, up, down)
    with a neighbour; ``up`` and ``down`` are the node numbers of its prefixes
    and suffixes by their length, ids follow the order of words."""
    size = F.length("word")

    def member(i: Column, rest: Column, inserts: bool, first: Column) -> Column:
        return F.struct(F.get("up", i).alias("a"), F.get("down", rest).alias("b"), F.struct(
            F.col("n"), (-F.col("id")).alias("order"), F.lit(inserts).alias("inserts"), first.alias("first")).alias("m"))

    # Leaving out any letter of a run (aa) gives the same word: only the run's
    # first one counts against inserts, so no two words meet twice.
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: member(i, size - 1 - i, False, (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))))
    inserts = F.transform(F.sequence(F.lit(0), size), lambda i: member(i, size - i, True, F.lit(False)))
    pairs = words.select("id", "n", "word", "up", "down", F.split("word", "").alias("letters")).select(F.inline(F.concat(skips, inserts)))
    groups = pairs.groupBy("a", "b").agg(F.sort_array(F.collect_list("m"), asc=False).alias("ms")).filter(F.size("ms") > 1)
    groups = groups.select("ms", F.filter("ms", lambda m: ~m["inserts"]).alias("skips"),
                           F.filter("ms", lambda m: m["first"]).alias("firsts"))

    def found(m: Column) -> Column:
        # A skip's neighbours: the other skips, and the insert where it is the
        # first of its run. An insert's neighbours: skips that are the first.
        other = F.when(F.get("skips", F.lit(0)) == m, F.get("skips", F.lit(1))).otherwise(F.get("skips", F.lit(0)))
        insert = F.when(m["first"], F.get(F.filter("ms", lambda x: x["inserts"]), F.lit(0)))
        near = F.when(m["inserts"], F.size("firsts")).otherwise(
            F.size("skips") - 1 + F.when(m["first"], F.size("ms") - F.size("skips")).otherwise(0))
        best = F.when(m["inserts"], F.get("firsts", F.lit(0))).otherwise(F.greatest(other, insert))
        return F.struct((-m["order"]).alias("id"), near.cast("long").alias("near"),
                        F.struct(best["n"].alias("n"), best["order"].alias("order")).alias("best"))

    return (groups.select(F.inline(F.transform("ms", found))).filter("near > 0")
            .groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")))


def roots(links: DataFrame) -> DataFrame:
    """id, root of each row of ``links`` (id, form), following forms to the
    last by doubling: as n at least doubles from form to form, a handful of
    rounds reach the end of every chain."""
    step, before, ends = 0, None, links.select("id", F.col("form").alias("root"))
    while True:
        hop = ends.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = written(ends.join(hop, "root", "left").select("id", F.coalesce("next", "root").alias("root"),
                                                              F.col("next").isNotNull().alias("moved")), f"roots-{step}")
        if step:
            remove(links.sparkSession, before)  # the round before has been read
        before, ends, step = moved, moved.select("id", "root"), step + 1
        if moved.filter("moved").isEmpty():
            return ends


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, factor: int = 2, slip_every: int | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``least_length``
    code points and ``least_count`` occurrences in all texts.

    Near words differ by one inserted, deleted or replaced code point. ``form``
    is the near word of largest n (ties: smallest in code-point order) if that
    is ``factor`` (2 or more) times the word's own n at least, else null;
    ``root`` follows forms to the last. Null and empty texts have no words.
    Repeated rows count each; null ids count as empty (they only matter for
    ``slip_every``, see ``slipped``); other columns are not read; an empty
    table gives an empty result. Words of any length are whole words.
    """
    counts = written(word_counts(docs, least_length, least_count, slip_every, id_col, text_col), "words")
    up = paths(counts.select(F.col("word").alias("key"), "n"), "up").select(F.col("key").alias("word"), "n", F.col("path").alias("up"))
    down = paths(counts.select(F.reverse("word").alias("key")), "down").select(F.reverse("key").alias("word"), F.col("path").alias("down"))
    words = written(up.join(down, "word").withColumn("id", F.element_at("up", -1)), "trie-words")
    near = neighbours(words)
    judged = written(words.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= factor * F.col("n"), F.struct((-F.col("best.order")).alias("id"), F.col("best.n").alias("n"))).alias("form")), "near")
    ends = roots(judged.filter("form is not null").select("id", F.col("form.id").alias("form")))
    name = judged.select("id", "word")
    return (judged.select(F.col("id").alias("own"), "word", "n", "n_near", F.col("form.n").alias("form_n"), F.col("form.id").alias("form_id"))
            .join(ends, F.col("own") == F.col("id"), "left").drop("id")
            .join(name.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id", "left")
            .join(name.select(F.col("id").alias("root"), F.col("word").alias("last")), "root", "left")
            .select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n"))
