"""Quality rules with robust multivariate outliers, in DataFrame functions.

Counts are taken inside each row with array functions, so no word or window
leaves its row. Transformed statistics of the documents that pass the base
rules form a vector. For each language and source, each language
and all together a minimum-covariance-determinant estimate is made: several
fixed starts improve by concentration steps (keep the nearest share of the
rows, estimate again) until no determinant falls, and the smallest one counts.
An estimate is drawn towards that of the next larger group by its number of
rows, so no size decides which one is used. Documents far out by Mahalanobis
distance are rejected. Estimates are small rows per group; document rows are
read again for each step, never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, text_of, written

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: A group of n rows has the weight n / (n + GROUP_ROWS) beside the estimate of
#: its language, and a language beside that of all rows.
GROUP_ROWS = 200
#: Share of a group's rows that a concentration step keeps, that of the inner
#: start, and the most steps (the determinant falls with each).
SHARE, CORE, STEPS = 0.75, 0.5, 12
#: What the logarithm of a determinant falls by in a step that counts.
LEAST = 1e-3
#: Groups whose estimates (a few hundred bytes each) are broadcast; with more of
#: them the planner chooses by the size of the table.
SENT_GROUPS = 50_000
#: Rank error of the cuts: one part of so many of a group's rows.
ACCURACY = 100_000
#: Statistics: (name, least standard deviation). The floors keep a statistic
#: that is equal in most documents from rejecting all others.
STATISTICS = [("x_length", 0.08), ("x_symbols", 0.35), ("x_lines", 0.6), ("x_repeat", 0.6)]
#: Squared distance beyond which a document is rejected.
CUTOFF = 50.0


def base_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    trimmed = F.btrim(F.col("_t"), F.lit(" \t\n\x0b\f\r"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in keep], text_of(text_col).alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    rows = rows.select(
        "doc_id", *keep,
        (F.size(F.split("_t", SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)).alias("_w"),
        lines.alias("_lines"))
    rows = rows.select(
        "doc_id", *keep, "n_symbols", F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    # A hash for each window, by its words' hashes.
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_h") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])))
    rows = rows.withColumn("_win", windows).drop("_h")
    repeated = F.size(F.array_distinct("_win")) < F.size("_win")
    # Where a window occurs twice: windows in order of hash, those equal to a
    # neighbour in order of place, and the words they cover together.
    rows = rows.withColumn("_s", F.when(repeated, F.sort_array(F.transform(
        "_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_win")
    same = F.transform(F.filter("_s", lambda x, k: (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"])),
                       lambda x: x["i"])
    rows = rows.withColumn("_p", F.sort_array(same)).drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def chi_square_share(x: float, degrees: int) -> float:
    """Distribution function of chi-square with an even number of degrees."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** k / math.factorial(k) for k in range(degrees // 2))


def consistency(share: float, degrees: int) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal
    rows that of all rows (Croux and Haesbroeck)."""
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_share(mid, degrees) < share else (low, mid)
    return share / chi_square_share(low, degrees + 2)


def distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance by the group's triangular factors m_i
    (centre), v_i (residual variance) and l_ij (regression on residual j)."""
    z: list[Column] = []
    for i, x in enumerate(names):
        z.append(F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * z[j] for j in range(i)), F.lit(0.0)))
    return sum((r * r / F.col(f"v{i}") for i, r in enumerate(z)), F.lit(0.0))


def factors(moments: DataFrame, floors: list[float], scale: float, by: list[str]) -> DataFrame:
    """Triangular factors of each group's covariance (columns c_ij, j <= i),
    scaled, with the floors' variances added to the diagonal."""
    p = len(floors)
    out = moments
    for i in range(p):
        for j in range(i):
            rest = F.col(f"c{i}{j}") * scale - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"v{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", rest / F.col(f"v{j}"))
        own = F.coalesce(F.col(f"c{i}{i}"), F.lit(0.0)) * scale + floors[i] ** 2
        rest = own - sum((F.col(f"l{i}{k}") ** 2 * F.col(f"v{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"v{i}", F.greatest(rest, F.lit(floors[i] ** 2)))
    return out.select(*by, *[f"m{i}" for i in range(p)], *[f"v{i}" for i in range(p)],
                      *[f"l{i}{j}" for i in range(p) for j in range(i)])


def sender(rows: DataFrame, by: list[str]):
    """What to do with a table of one row per group (and start) before rows are
    joined to it: broadcast it if the groups, which are counted, are few."""
    few = rows.select(*by).distinct().limit(SENT_GROUPS + 1).count() <= SENT_GROUPS
    return F.broadcast if few else lambda table: table


def moments(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    p = len(names)
    return rows.groupBy(*by).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(names)],
                                 *[F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)])


def nearest(rows: DataFrame, now: DataFrame, names: list[str], by: list[str], share: float, send) -> DataFrame:
    """The ``share`` of each group's rows that is nearest by the factors ``now``."""
    far = rows.join(send(now), by[0]).select(*by, *names, distance(names).alias("d"))
    limit = written(far.groupBy(*by).agg(F.percentile_approx("d", share, ACCURACY).alias("limit")), "mcd")
    return far.join(send(limit), by).filter("d <= limit")


def robust_estimates(rows: DataFrame, by: str, names: list[str], floors: list[float],
                     share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant factors of each value of ``by``, with the
    logarithm of the determinant (``det``).

    Three starts: medians and median deviations, the moments of all rows, and
    those of the half that is nearest to the first. All take concentration
    steps until no group's determinant falls (``steps`` at most); the smallest
    determinant of a group is its estimate.

    What is estimated (a row for each group and start) is written before it is
    joined to the rows, and broadcast if the groups are few: no row of a hot
    group has to move.
    """
    p, send = len(names), sender(rows, [by])
    middle = written(rows.groupBy(by).agg(*[F.percentile_approx(x, 0.5).alias(f"m{i}") for i, x in enumerate(names)]), "mcd")
    spread = (rows.join(send(middle), by).groupBy(by)
              .agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, x in enumerate(names)]))
    start = middle.join(spread, by)
    for i in range(p):
        start = start.withColumn(f"c{i}{i}", (F.col(f"s{i}") * 1.4826) ** 2)
        for j in range(i):
            start = start.withColumn(f"c{i}{j}", F.lit(0.0))
    median = written(factors(start, floors, 1.0, [by]), "mcd")
    plain = factors(moments(rows, names, [by]), floors, 1.0, [by])
    core = factors(moments(nearest(rows, median, names, [by], CORE, send), names, [by]), floors, consistency(CORE, p), [by])
    starts = [one.withColumn("start", F.lit(k)) for k, one in enumerate((median, plain, core))]
    now = written(starts[0].unionByName(starts[1]).unionByName(starts[2]).withColumn("det", F.lit(float("inf"))), "mcd")
    scale, det = consistency(share, p), sum((F.log(f"v{i}") for i in range(p)), F.lit(0.0))
    both = [by, "start"]
    fields = ["det", *[c for c in now.columns if c not in (*both, "det")]]
    for _ in range(steps):
        step = factors(moments(nearest(rows, now, names, both, share, send), names, both), floors, scale, both).withColumn("det", det)
        # A step that does not lower the determinant by LEAST is not taken.
        pair = now.select(*both, F.struct(*fields).alias("old")).join(step.select(*both, F.struct(*fields).alias("new")), both)
        falls = F.col("new.det") < F.col("old.det") - LEAST
        after = written(pair.select(*both, F.when(falls, F.col("new")).otherwise(F.col("old")).alias("best"), falls.alias("falls")), "mcd")
        now = after.select(*both, "best.*")
        if after.filter("falls").isEmpty():
            break
    best = now.groupBy(by).agg(F.min(F.struct("det", "start", *fields[1:])).alias("best"))
    return best.select(by, "best.*").drop("start")


def covariances(p: int) -> dict[str, Column]:
    """c_ij (j <= i) of the covariance that has the triangular factors."""
    def below(i: int, j: int) -> Column:
        return F.lit(1.0) if i == j else F.col(f"l{i}{j}")

    return {f"c{i}{j}": sum((below(i, k) * below(j, k) * F.col(f"v{k}") for k in range(j + 1)), F.lit(0.0)) for i in range(p) for j in range(i + 1)}


def drawn(groups: DataFrame, estimates: DataFrame, levels: list[str], p: int, group_rows: int) -> DataFrame:
    """Factors for each row of ``groups``: the estimate of its first level (a
    column that names it) drawn towards that of the next one, and so on, by
    the number of rows ``n`` of each."""
    known = estimates.select("grp", "n", *[f"m{i}" for i in range(p)], *[c.alias(x) for x, c in covariances(p).items()])
    numbers = known.columns[2:]
    out, value = groups, {}
    for k, level in enumerate(levels):
        out = out.join(known.select(F.col("grp").alias(level), F.col("n").alias(f"n_{k}"), *[F.col(x).alias(f"{x}_{k}") for x in numbers]), level)
    for k in reversed(range(len(levels))):
        weight = F.col(f"n_{k}") / (F.col(f"n_{k}") + group_rows)
        value = {x: F.col(f"{x}_{k}") * weight + value[x] * (1 - weight) if value else F.col(f"{x}_{k}") for x in numbers}
    # The floors are in the covariances already.
    return factors(out.select(*groups.columns, *[value[x].alias(x) for x in numbers]), [1e-6] * p, 1.0, groups.columns)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", cutoff: float = CUTOFF, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance, kept for every row.

    Null text has no words and fails the base rules (fewer than 20 words, or
    more than 30 % of the words in repeated windows). Null languages and
    sources are values like any other. distance is null where the base rules
    failed. Null ids pass through, repeated rows are judged each, other columns
    are not read. Windows are compared by 64-bit hashes within a document.
    """
    counts = base_counts(docs.withColumns({"_lang": F.col(lang_col), "_source": F.col(source_col)}), id_col, text_col, ["_lang", "_source"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # Rates are drawn towards a common value in short documents, where they vary most.
    rows = written(counts.select(
        "doc_id", "_lang", "_source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.log((F.col("word_chars") + 600) / (F.col("n_words") + 100)).alias("x_length"),
        F.log1p(100.0 * F.col("n_symbols") / (F.col("n_words") + 100)).alias("x_symbols"),
        F.log1p(100.0 * F.col("n_dup_lines") / (F.col("n_lines") + 20)).alias("x_lines"),
        F.log1p(100.0 * F.col("n_repeat_words") / (F.col("n_words") + 100)).alias("x_repeat")), "rules")
    names, floors = [n for n, _ in STATISTICS], [f for _, f in STATISTICS]
    key = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    sound = rows.filter("not base_failed")
    levels = {"g0": key("_lang", "_source"), "g1": key("_lang"), "g2": F.lit("all")}
    groups = sound.select(F.col("_lang").alias("_gl"), F.col("_source").alias("_gs"), *[c.alias(g) for g, c in levels.items()]).distinct()
    placed = sound.select(F.explode(F.array(*levels.values())).alias("grp"), *names)
    sizes = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    estimates = written(robust_estimates(placed, "grp", names, floors).join(sizes, "grp"), "estimates")
    model = written(drawn(groups, estimates, list(levels), len(names), group_rows), "groups")
    member = F.col("_lang").eqNullSafe(F.col("_gl")) & F.col("_source").eqNullSafe(F.col("_gs"))
    send = sender(model, ["_gl", "_gs"])
    judged = (rows.join(send(model), member & ~F.col("base_failed"), "left")
              .withColumn("distance", distance(names)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"))
