"""Language identification: the family first, then the language within it.

Linear support vector machines decide one family against another and, inside a
family, one language against another. Their features are the relative
frequencies of hashed letter n-grams (one to three letters with word borders)
over the whole text. Each machine is trained in a task of its own on a bounded
sample; a text's margin is the mean of its words' weights, so tasks score each
distinct word of a batch once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import coded_words, hash_fraction, one_text, slices, text_of

# Language families by ISO 639-1 code. A language that is not
# listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "semitic": ["am", "ar", "he", "mt"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "ug", "uz"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "austronesian": ["id", "jv", "ms", "su", "tl"],
}
#: Feature space: 2 to this power.
HASH_BITS = 13
#: Documents of each language that training uses at most, on average.
LANGUAGE_ROWS = 300
#: Languages that are learned at most: those with the most documents. Texts of
#: others are predicted as the learned one that is nearest.
LANGUAGES = 200


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every letter n-gram of the words."""
    text = "\n" + "\n".join(words).lower() + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    breaks = c == 10
    of = np.cumsum(breaks) - 1  # a break counts to the word after it
    kinds, kind = np.unique(c, return_inverse=True)
    letter = np.array([chr(k).isalpha() for k in kinds])[kind]
    c = np.where(letter, c, 0)  # every other character is a border
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = np.flatnonzero(letter[1:-1])
    grams = np.concatenate([c[one], (c[two] * 1_000_003 + c[two + 1]) ^ 1 << 40,
                            ((c[three] * 1_000_003 + c[three + 1]) * 1_000_003 + c[three + 2]) ^ 1 << 62])
    # A gram that begins with a letter or a border belongs to the word begun last.
    word = np.concatenate([of[one], of[two], of[three + 1]])
    bucket = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)
    return word, bucket.astype(np.int64)


def frequencies(texts: list[str]) -> np.ndarray:
    """Relative n-gram frequencies, scaled to length 1, a row for each text."""
    out = np.zeros((len(texts), 1 << HASH_BITS), np.float32)
    for row, t in zip(out, texts):
        row += np.bincount(word_grams(t.split())[1], minlength=1 << HASH_BITS).astype(np.float32)
        row /= max(1.0, float(row.sum()))
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted alike, by
    accelerated gradient descent. y is 1 or -1."""
    scale = 1 / np.sqrt((x * x).sum(axis=1).mean())
    x = np.hstack([x * scale, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    v = np.ones(x.shape[1], np.float32)
    for _ in range(15):  # largest curvature
        v = x.T @ (share * (x @ v)).astype(np.float32)
        v /= np.linalg.norm(v)
    rate = 1 / (1 + 2 * c * float(v @ (x.T @ (share * (x @ v)).astype(np.float32))))
    w = old = np.zeros(x.shape[1])
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - old)
        slack = np.maximum(0, 1 - y * (x @ ahead.astype(np.float32)))
        gradient = ahead - 2 * c * (x.T @ (share * slack * y).astype(np.float32))
        old, w = w, ahead - rate * gradient
    return w[:-1] * scale, float(w[-1])


def fit(docs: DataFrame, eligible: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        language_rows: int = LANGUAGE_ROWS, languages: int = LANGUAGES) -> dict:
    """Train on a repeatable sample of about ``language_rows`` documents of
    each language among the rows that are ``eligible`` and have a language.
    Of more than ``languages`` values of the column those with the most
    documents are learned (ties: the first names), so a dirty column does not
    make a machine for every pair of its values."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), text_of(text_col).alias("t"),
                       eligible.alias("ok")).filter("ok and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    langs = sorted(counts)
    families = sorted({family_of(x) for x in langs})
    pairs = [("family", a, b) for i, a in enumerate(families) for b in families[i + 1:]]
    pairs += [("lang", a, b) for i, a in enumerate(langs) for b in langs[i + 1:] if family_of(a) == family_of(b)]
    models: dict = {"langs": langs, "pairs": pairs, "weights": []}
    if not pairs:
        return models
    chosen = F.lit(False)
    sides = F.array().cast("array<struct<k:int,y:int>>")
    for lang in langs:
        mine = [(k, 1 if a in (lang, family_of(lang)) else -1) for k, (level, a, b) in enumerate(pairs)
                if (lang if level == "lang" else family_of(lang)) in (a, b)]
        here = F.col("lang") == lang
        chosen = F.when(here, hash_fraction("id", counts[lang], language_rows)).otherwise(chosen)
        sides = F.when(here, F.array(*[F.struct(F.lit(k).alias("k"), F.lit(y).alias("y")) for k, y in mine])
                       .cast("array<struct<k:int,y:int>>")).otherwise(sides)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "t"])
        w, b = svm(frequencies(pdf["t"].tolist()), pdf["y"].to_numpy())
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "w": [w.astype("<f4").tobytes()], "b": [b]})

    trained = (one_text(rows.filter(chosen), "id", "lang").select("id", "t", F.explode(sides).alias("side")).select("id", "t", "side.k", "side.y")
               .groupBy("k").applyInPandas(learn, "k int, w binary, b double").collect())
    models["weights"] = {r["k"]: (np.frombuffer(r["w"], "<f4"), r["b"]) for r in trained}
    return models


def contest(names: list[str], margins: dict) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one: (winner's number, its share of the votes). A vote is
    the logistic function of a margin; ties go to the first name."""
    rows = len(next(iter(margins.values())))
    votes = np.zeros((rows, len(names)))
    for (a, b), m in margins.items():
        p = 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        votes[:, names.index(a)] += p
        votes[:, names.index(b)] += 1 - p
    best = votes.argmax(axis=1)
    return best, votes[np.arange(rows), best] / (len(names) - 1)


def predict(docs: DataFrame, models: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row. Null texts and texts
    without a letter are ``und`` with score 0, and so are all texts where no
    language was learned. With one language learned it is the prediction, with
    score 1. Null ids pass through, repeated rows are predicted each, other
    columns are not read."""
    langs, pairs, weights = models["langs"], models["pairs"], models["weights"]

    def run(batches):
        names = np.array([*langs, "und"], object)
        families = sorted({family_of(x) for x in langs})
        w = np.stack([weights[k][0] for k in range(len(pairs))], axis=1).astype(np.float64) if pairs else None
        bias = np.array([weights[k][1] for k in range(len(pairs))])

        def decide(level, options, rows, margin):
            if len(options) == 1:
                return np.zeros(len(rows), np.int64), np.ones(len(rows))
            return contest(options, {(a, b): margin[rows, k] for k, (kind, a, b) in enumerate(pairs)
                                     if kind == level and a in options and b in options})

        for batch in batches:
            for i, j in slices(batch.column(1)):
                texts = batch.column(1).slice(i, j - i)
                best, score = np.full(j - i, len(langs)), np.zeros(j - i)
                real = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) if langs else np.zeros(j - i, bool)
                rows = np.flatnonzero(real)
                if len(rows) and not pairs:
                    best[rows], score[rows] = 0, 1.0
                elif len(rows):
                    words, codes, starts = coded_words(pc.replace_substring_regex(texts, r"[\t\n\v\f\r]", " "))
                    word, bucket = word_grams(words.to_pylist())
                    grams = np.bincount(word, minlength=len(words))
                    total = np.r_[0, np.cumsum(grams[codes])]
                    size = np.maximum(1, np.diff(total[starts]))[:, None]
                    margin = np.empty((j - i, len(pairs)))
                    for k in range(len(pairs)):
                        sums = np.bincount(word, weights=w[bucket, k], minlength=len(words))
                        total = np.r_[0.0, np.cumsum(sums[codes])]
                        margin[:, k] = np.diff(total[starts])
                    margin = margin / size + bias
                    family, sure = decide("family", families, rows, margin)
                    for f, name in enumerate(families):
                        mine = rows[family == f]
                        if len(mine):
                            inside = [x for x in langs if family_of(x) == name]
                            lang, within = decide("lang", inside, mine, margin)
                            best[mine] = np.array([langs.index(x) for x in inside])[lang]
                            score[mine] = sure[family == f] * within
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[best].tolist(), pa.string()),
                                                  pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
