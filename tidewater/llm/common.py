"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import checkpoint_root

# One or more of space, tab, line feed, vertical tab, form feed, return.
SPACES = "[ \\t-\\r]+"
#: Text bytes handled at once inside a task.
SLICE_BYTES = 6 << 20


def text_of(col: str) -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(col: str) -> Column:
    """The words of a text: maximal runs without white space."""
    return F.filter(F.split(text_of(col), SPACES), lambda w: w != "")


def crc_class(col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (-1 for a null id)."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus, F.lit(-1))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: lineage
    is cut and the rows survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidewater/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    for made in _made[-1:]:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


#: What is written within the innermost ``scratch``.
_made: list[list[str]] = []


@contextmanager
def scratch():
    """The paths that ``written`` makes inside the block, as a list to be
    removed when no result reads them any more."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield paths
    finally:
        _made.remove(paths)


def remove(spark: SparkSession, *written_or_paths) -> None:
    """Remove tables that ``written`` returned (or their paths) from the shared
    folder, on whatever file system it is."""
    for x in written_or_paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x if isinstance(x, str) else x.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_fraction(col: str, rows: int, most: int) -> Column:
    """True for a repeatable share of ids such that about ``most`` of ``rows``
    remain (all of them when there are no more)."""
    if rows <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.col(col)), F.lit(1_000_000)) < int(1e6 * most / rows)


def one_text(sample: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of each labelled id (``keys``) the smallest text ``t``:
    however often an id repeats, a sample has one row of it."""
    return sample.groupBy(*keys).agg(F.min("t").alias("t"))


def slices(texts, most: int = SLICE_BYTES):
    """(start, end) ranges over an Arrow string array of about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def coded_words(texts, separator: str = " "):
    """Arrow texts split at ``separator``: (distinct words as an Arrow array,
    number of each word in order, start of each text's words)."""
    parts = pc.split_pattern(texts, separator)
    codes = pc.dictionary_encode(parts.flatten())
    starts = parts.offsets.to_numpy().astype(np.int64)
    return codes.dictionary, codes.indices.to_numpy().astype(np.int64), starts - starts[0]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order (by sorting, in place)."""
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]][:len(x)]]


def hashed(words) -> np.ndarray:
    """64-bit hashes of Arrow strings, the same in every task."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def shapes_of(words) -> list[str]:
    """Shape of each Arrow string without line feeds: runs of lower-case
    letters as a, of capitals as A, of digits as 0, all else as it is."""
    text = "\n".join(words.to_pylist())
    for kind, sign in ((r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a"), (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"\d+", "0")):
        text = re.sub(kind, sign, text)
    return text.split("\n") if len(words) else []


def repetition(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of word numbers: how many words equal the word before,
    and how many three-word windows occurred earlier in the text."""
    texts = len(starts) - 1
    doc = np.repeat(np.arange(texts), np.diff(starts))
    if len(codes) < 3:
        same = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
        return np.bincount(doc[1:][same], minlength=texts), np.zeros(texts, np.int64)
    same = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    whole = doc[2:] == doc[:-2]
    c = codes.astype(np.uint64)
    window = ((c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:])[whole]
    window = (window ^ (window >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + doc[2:][whole].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    _, first = np.unique(window, return_index=True)
    of = doc[2:][whole]
    return np.bincount(doc[1:][same], minlength=texts), np.bincount(of, minlength=texts) - np.bincount(of[first], minlength=texts)
