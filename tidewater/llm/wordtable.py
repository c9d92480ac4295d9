"""BPE encoding by a table of distinct words, and decoding by a table of pieces.

Encoding. Tasks split whole texts into words and write blocks of text, some
documents a row: the number of every word in order (compressed), and the
block's own distinct words. The distinct words of all blocks form one table,
sorted by word, in which each word is encoded once by the library for all its places;
brought back to their blocks the ids are the block's dictionary, and the
numbers of its words put them at their positions. Words of a frequent-word
table (bounded, made from a sample of documents, encoded once as well) have
fixed numbers and take no part in the shuffles. Blocks are written bucketed,
so only dictionaries travel to them.

Decoding. The id-to-piece table has one row per vocabulary entry, a proven
bound; tasks join ids with it and concatenate the pieces' bytes.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewater.llm.common import hash_fraction, ragged, slices, text_of
from tidewater.llm.tokens import byte_alphabet
from tidewater.session import shared_dir

#: Bytes of text of a block (a single longer text is a block of its own), and
#: bytes split at once, which are a row of it.
BLOCK_BYTES, SPLIT_BYTES = 32 << 20, 2 << 20
#: Words whose ids are put in place at once.
PLACE_WORDS = 1 << 19
#: Frequent words, their longest in bytes, and the documents they are counted in.
FREQUENT, FREQUENT_BYTES, SAMPLE_DOCS = 200_000, 48, 20_000
#: Ids decoded at once.
DECODE_IDS = 1 << 21

BLOCK = "block long, doc_ids array<long>, n_words array<int>, numbers binary, first int, words array<string>"


class Splitter:
    """Words of texts such that a text's ids are those of its words in turn.

    Texts of plain characters are split by the vocabulary's pre-token pattern.
    In other texts (characters whose class may differ between versions of
    Unicode, special strings) a word is a run up to white space that follows a
    character that is none: no pre-token holds a character and white space
    after it.
    """

    def __init__(self, pattern: str, specials: list[str]):
        import regex

        self.pre_tokens = regex.compile(pattern).findall
        self.odd = re.compile("|".join(["[\x1c-\x1fɐ-\U0010ffff]", *map(re.escape, specials)])).search
        self.chunks = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\n\r])").split

    def words(self, text: str) -> list[str]:
        if not self.odd(text):
            return self.pre_tokens(text)
        return [w for w in self.chunks(text) if w]


def give_back() -> None:
    """Return memory that is free, but kept by the allocators, to the system:
    a worker keeps it from stage to stage, beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # GNU libc
        trim(0)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, first bytes first, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(n) if n else np.zeros(0, np.uint32)


def flat_words(splitter: Splitter, texts: list[str]) -> tuple[pa.Array, list[str], list[int]]:
    """(index of each word in the distinct words, these, words of each text)."""
    flat, n = [], []
    for t in texts:
        w = splitter.words(t)
        flat += w
        n.append(len(w))
    codes = pc.dictionary_encode(pa.array(flat, pa.large_string()))
    return codes.indices, codes.dictionary.to_pylist(), n


def frequent_words(docs: DataFrame, splitter: tuple, most: int, sample: int) -> list[str]:
    """The ``most`` commonest words of at most FREQUENT_BYTES bytes among about
    ``sample`` documents chosen by hash of the id."""
    def run(batches):
        split = Splitter(*splitter)
        for b in batches:
            for i, j in slices(b.column(0), SPLIT_BYTES):
                codes, words, _ = flat_words(split, b.column(0).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "n"])

    chosen = docs.filter("doc_id is not null").filter(hash_fraction("doc_id", docs.count(), sample))
    counted = (chosen.select("t").mapInArrow(run, "word string, n long").filter(F.octet_length("word") <= FREQUENT_BYTES)
               .groupBy("word").agg(F.sum("n").alias("n")))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def blocks_of(docs: DataFrame, splitter: tuple, frequent: list[str], block_bytes: int) -> DataFrame:
    """Rows of blocks: some documents of a block, their numbers of words, the
    number of every word (below the frequent words' count: those; from there
    on: the block's own words in turn), and the own words that no row of the
    block had before, with the number of those that had been. Rows leave as
    they are made, so a task holds a block's own words and no more of it."""
    def run(batches):
        split = Splitter(*splitter)
        fixed = {w: k for k, w in enumerate(frequent)}
        part, made = TaskContext.get().partitionId(), 0
        own, size = {}, 0
        for b in batches:
            for i, j in slices(b.column(1), SPLIT_BYTES):
                texts, first = b.column(1).slice(i, j - i), len(own)
                codes, words, n = flat_words(split, texts.to_pylist())
                number = np.fromiter((fixed[w] if w in fixed else own.setdefault(w, len(fixed) + len(own)) for w in words), np.uint32, len(words))
                yield pa.RecordBatch.from_arrays([
                    pa.array([part << 24 | made]), pa.array([b.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    pa.array([n], pa.list_(pa.int32())), pa.array([packed(number[codes.to_numpy()])], pa.binary()),
                    pa.array([first], pa.int32()), pa.array([list(own)[first:]], pa.list_(pa.string())),
                ], names=["block", "doc_ids", "n_words", "numbers", "first", "words"])
                size += pc.sum(pc.binary_length(texts)).as_py()
                if size >= block_bytes:
                    made, own, size = made + 1, {}, 0
                    give_back()
        b = texts = codes = words = number = None  # else held until the generator ends
        give_back()

    return docs.mapInArrow(run, BLOCK)


def library(spec: str):
    """``encode_batch`` of a vocabulary's text, on this task's thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return lambda words: [e.ids for e in t.encode_batch(words, add_special_tokens=False)]


def encoded_places(words: DataFrame, spec: str) -> DataFrame:
    """block, pos, ids (little-endian 32-bit numbers) of every place of a
    word. All places of a word come one after another, whatever their number,
    and the word is encoded at the first of them."""
    def run(batches):
        encode = library(spec)
        last, last_ids = None, b""
        for b in batches:
            runs = pc.run_end_encode(b.column(2))
            distinct = runs.values.to_pylist()
            new = distinct[1:] if distinct[:1] == [last] else distinct
            ids = [last_ids] * (len(distinct) - len(new)) + [np.array(x, "<i4").tobytes() for x in encode(new)]
            at = np.diff(runs.run_ends.to_numpy(), prepend=0)
            last, last_ids = (distinct[-1], ids[-1]) if distinct else (last, last_ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()).take(pa.array(np.repeat(np.arange(len(ids)), at)))],
                                             names=["of_block", "pos", "ids"])
        encode = b = runs = distinct = new = ids = None  # else held until the generator ends
        give_back()

    return (words.repartition("word").sortWithinPartitions("word").select("of_block", "pos", "word")
            .mapInArrow(run, "of_block long, pos int, ids binary"))


def bucketed(df: DataFrame, name: str, key: str) -> str:
    """Name of a table with the rows of ``df``, bucketed by ``key`` in the
    shared folder with as many buckets as shuffle partitions: read again, it
    needs no shuffle to meet rows of the same key."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex[:12]}"
    (df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
     .options(path=shared_dir(spark, f"llm-{name}"), compression="zstd").saveAsTable(name))
    return name


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES, frequent: int = FREQUENT, sample: int = SAMPLE_DOCS,
           decoded: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``docs``, as the tokenizers
    library encodes the whole text without added special tokens, truncation or
    padding; special strings inside texts become their ids.

    ``vocabulary`` is the path of a byte-level BPE file, read on the driver;
    ``pattern`` its pre-token pattern. Null and empty texts have no ids.
    Repeated rows are encoded each, null ids pass through, other columns are
    not read, an empty table gives an empty result. Long texts are whole words
    and blocks like others. ``frequent`` may be 0; results never depend on it.
    ``decoded`` names a further column with the text that the ids decode to
    (see ``decode``), made where the ids are, without another step.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    splitter = (pattern, [t["content"] for t in json.loads(spec)["added_tokens"]])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    common = frequent_words(rows, splitter, frequent, sample) if frequent else []
    fixed = library(spec)(common)
    fixed_n = np.fromiter(map(len, fixed), np.int64, len(fixed))
    fixed_ids = np.fromiter((i for x in fixed for i in x), np.int32, fixed_n.sum())

    blocks = bucketed(blocks_of(rows, splitter, common, block_bytes), "word_blocks", "block")
    spark = docs.sparkSession
    words = spark.table(blocks).select(F.col("block").alias("of_block"), "first", F.posexplode("words").alias("at", "word"))
    words = words.withColumn("pos", F.col("first") + F.col("at"))
    pieces = padded_pieces(vocabulary) if decoded else None
    names = ["doc_id", "ids", *([decoded] if decoded else [])]

    def place(block: pa.Table, own: pa.Table) -> pa.Table:
        give_back()
        own = own.select(["pos", "ids"]).sort_by("pos").column("ids").combine_chunks()
        n = np.r_[fixed_n, pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64) // 4]
        ids = np.r_[fixed_ids, np.frombuffer(b"".join(own.to_pylist()), "<i4")].astype(np.int32)
        begin, parts = np.cumsum(n) - n, []
        for row in range(block.num_rows):
            doc_ids, n_words = (block.column(c)[row].values for c in ("doc_ids", "n_words"))
            n_words = n_words.to_numpy().astype(np.int64)
            number = unpacked(block.column("numbers")[row].as_py(), n_words.sum())
            ends = np.r_[0, np.cumsum(n_words)]
            part = (ends[1:] - n_words) // PLACE_WORDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n_words)]
            for i, j in zip(cuts, cuts[1:]):
                some = number[ends[i]:ends[j]]
                size = n[some]
                total = np.r_[0, np.cumsum(size)][ends[i:j + 1] - ends[i]]
                lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids[ragged(begin[some], size)]))
                parts.append(pa.Table.from_arrays([doc_ids.slice(i, j - i), lists, *([joined_pieces(lists, pieces)] if decoded else [])], names=names))
        give_back()
        return pa.concat_tables(parts)

    return (spark.table(blocks).select("block", "doc_ids", "n_words", "numbers").groupBy("block")
            .cogroup(encoded_places(words, spec).groupBy("of_block"))
            .applyInArrow(place, "doc_id long, ids array<int>" + (f", `{decoded}` string" if decoded else "")))


def pieces_of(vocabulary: str) -> pa.Array:
    """The bytes of each id of a byte-level vocabulary (none for unused ids)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    pieces = [b""] * (max(tokens.values()) + 1)
    for token, i in tokens.items():
        pieces[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return pa.array(pieces, pa.large_binary())


def padded_pieces(vocabulary: str) -> pa.Array:
    """``pieces_of`` and, last, no bytes: the piece of ids that don't exist."""
    return pa.concat_arrays([pieces_of(vocabulary), pa.array([b""], pa.large_binary())])


def joined_pieces(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
    known = np.where((flat >= 0) & (flat < len(pieces) - 1), flat, len(pieces) - 1)
    found = pieces.take(pa.array(known))
    at = np.frombuffer(found.buffers()[1], np.int64)[found.offset:found.offset + len(found) + 1] if len(found) else np.zeros(1, np.int64)
    ends = at[np.r_[0, np.cumsum(n)]]
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), found.buffers()[2]])
    try:
        return texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of their ids (special tokens included) in
    ``text_col``, replacing a column of that name. Null or empty lists give an
    empty text; ids that the vocabulary does not have, and null ids, give
    nothing. Other columns stay."""
    pieces = padded_pieces(vocabulary)
    kept = rows.drop(text_col)
    names = [*kept.columns, text_col]
    at = names.index(ids_col)

    def run(batches):
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(n) - n) // DECODE_IDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    s = b.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*s.columns, joined_pieces(s.column(at), pieces)], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema, StructField(text_col, StringType())]))
