"""The whole corpus as ids of a public byte-level tokenizer, through a table of different words.

Texts are split into words in the JVM by the tokenizer's own pattern, once. Documents stay where
they were read: those of an Arrow batch are blocks of at most ``block_words`` words (a longer text
is one by itself), and a block is written as one row, its words as compressed codes. A word that
is itself a piece of the vocabulary has that piece's id as its code, as the tokenizer defines; the
others are numbered within the block. So only different words of many pieces are joined, once for
each block: they meet the table of different words, each encoded once, and their ids come back
to the block and there to each position. Frequent words are pieces, so none is a hot key.

The pattern's classes are those of the JVM's Unicode version. A text with a code point that the
JVM does not know (class Cn) is split by the tokenizer library instead.

Defined results for odd input: an empty and a NULL text give an empty list; strings that look
like special tokens are ordinary text; each input row gives one row, repeated or NULL keys too;
an empty table gives no rows. Only the key and the text are read, so other columns never clash.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

VOCABULARY = "byte_bpe_50k"
#: White space of Unicode (fixed values): Java's own class has less.
SPACE = r"\t-\r \x85\xA0  -     　"
#: The tokenizer's pattern with that class written out.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def vocabulary_folder() -> str:
    """Where the public vocabulary files are; TOKENIZERS_DIR names another place."""
    if named := os.environ.get("TOKENIZERS_DIR"):
        return named
    import public_tokenizers

    return os.path.dirname(public_tokenizers.__file__)


@lru_cache(maxsize=2)
def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


@lru_cache(maxsize=2)
def _encoder(data: bytes):  # noqa: ANN202
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(data), special_tokens={})


def vocabulary(folder: str | None = None, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder or vocabulary_folder(), f"{name}.tiktoken"), "rb") as file:
        return file.read()


def split_columns(text: str) -> list[Column]:
    """The words of a text column in order (NULL for a NULL text), and the texts the library must split."""
    strange = F.col(text).rlike(r"\p{Cn}")
    return [F.regexp_extract_all(F.when(~strange, F.col(text)), F.lit(WORD), F.lit(0)).alias("words"), F.when(strange, F.col(text)).alias("text")]


def _library_words(texts: list[str]) -> list[list[str]]:
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True)
    return [[t[a:b] for _, (a, b) in split.pre_tokenize_str(t)] for t in texts]


def _pack(keys: pa.Array, lists: pa.Array, ranks: dict[bytes, int], block_words: int) -> Iterator[tuple]:
    """(keys, words of each document, codes, words without a code) of each block."""
    import zstandard

    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, flat, at = np.r_[0, np.cumsum(sizes)], lists.flatten(), 0
    while at < len(keys):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + block_words, "right")) - 1)
        part = flat.slice(upto[at], upto[end] - upto[at]).dictionary_encode()
        code, unknown = np.empty(len(part.dictionary), np.int32), []
        for i, word in enumerate(part.dictionary.to_pylist()):
            piece = ranks.get(word.encode())
            if piece is None:
                unknown.append(word)
                piece = -len(unknown)
            code[i] = piece
        codes = code[part.indices.to_numpy(zero_copy_only=False)] if len(part) else code
        yield keys.slice(at, end - at), sizes[at:end], zstandard.ZstdCompressor(level=1).compress(codes.tobytes()), unknown
        at = end


def _coded(docs: DataFrame, key: str, text: str, data: bytes, block_words: int) -> DataFrame:
    """One row for each block: (block, keys, sizes, codes, words)."""
    kind = docs.schema[key].dataType
    shared = docs.sparkSession.sparkContext.broadcast(data)  # of fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(shared.value)
        for batch in batches:
            keys, lists, texts = batch.columns
            strange = texts.is_valid()
            parts = [(keys, lists)]
            if pc.any(strange).as_py():
                plain = pc.invert(strange)
                parts = [(keys.filter(plain), lists.filter(plain)), (keys.filter(strange), pa.array(_library_words(texts.filter(strange).to_pylist()), pa.list_(pa.string())))]
            for held, words in parts:
                for some, sizes, codes, unknown in _pack(held, words, ranks, block_words):
                    one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
                    yield pa.RecordBatch.from_arrays([one(some, None), one(sizes, pa.int64()), pa.array([codes], pa.binary()), one(unknown, pa.string())], names=["keys", "sizes", "codes", "words"])

    split = docs.select(F.col(key).alias("key"), *split_columns(text))
    rows = split.mapInArrow(run, f"keys array<{kind.simpleString()}>, sizes array<bigint>, codes binary, words array<string>")
    return cut_lineage(rows.withColumn("block", F.monotonically_increasing_id()))


def _encoded(coded: DataFrame, data: bytes) -> DataFrame:
    """(block, at, ids) of the words without a code, every different word encoded once."""
    pairs = coded.select("block", F.posexplode("words").alias("at", "word"))
    shared = coded.sparkSession.sparkContext.broadcast(data)  # of fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            ids = [encoder.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return pairs.join(pairs.select("word").distinct().mapInArrow(run, "word string, ids array<int>"), "word").select("block", "at", "ids")


def _unpacked(block: pa.Table, words: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """Keys, the documents' bounds among the ids, codes and bounds of the words, and the ids of words without a code."""
    import zstandard

    keys, sizes = block["keys"].combine_chunks().flatten(), block["sizes"].combine_chunks().flatten().to_numpy()
    codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block["codes"][0].as_py()), np.int32)
    ids = words["ids"].combine_chunks().take(pa.array(np.argsort(words["at"].to_numpy()))) if len(words) else pa.array([], pa.list_(pa.int32()))
    n = np.ones(len(codes), np.int64)
    own = codes < 0
    if own.any():
        n[own] = pc.list_value_length(ids).to_numpy(zero_copy_only=False)[-codes[own] - 1]
    bounds = np.r_[0, np.cumsum(n)]
    return keys, bounds[np.r_[0, np.cumsum(sizes)].astype(np.int64)], codes, bounds, ids


def _finished(docs: DataFrame, key: str, text: str, folder: str | None, block_words: int, finish, schema: str) -> DataFrame:  # noqa: ANN001
    data = vocabulary(folder)
    coded = _coded(docs, key, text, data, block_words)
    blocks = coded.select(F.col("block").alias("place"), "keys", "sizes", "codes")
    return blocks.groupBy("place").cogroup(_encoded(coded, data).groupBy("block")).applyInArrow(finish, f"{key} {docs.schema[key].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", *, folder: str | None = None, block_words: int = 1 << 18) -> DataFrame:
    """(key, ids) of every document."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, upto, codes, bounds, ids = _unpacked(left, right)
        flat, own = np.empty(bounds[-1], np.int32), codes < 0
        flat[bounds[:-1][~own]] = codes[~own]
        if own.any():
            used = ids.take(pa.array((-codes[own] - 1).astype(np.int32)))
            place = np.ones(bounds[-1], bool)
            place[bounds[:-1][~own]] = False
            flat[place] = used.flatten().to_numpy()
        return pa.table([keys, pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat))], names=[key, "ids"])

    return _finished(docs, key, text, folder, block_words, finish, "ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", *, folder: str | None = None, block_words: int = 1 << 18) -> DataFrame:
    """(key, n_tokens) of every document: the same join with only the words' numbers of ids."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, upto, _, _, _ = _unpacked(left, right)
        return pa.table([keys, pa.array(np.diff(upto))], names=[key, "n_tokens"])

    return _finished(docs, key, text, folder, block_words, finish, "n_tokens bigint")


def pieces(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(id, piece): the bytes of each id in hexadecimal, as many rows as the vocabulary has."""
    return spark.createDataFrame([(i, b.hex()) for b, i in _ranks(vocabulary(folder)).items()], "id int, piece string")


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", *, folder: str | None = None, chunk: int = 4096) -> DataFrame:
    """(key, text): ids joined with their pieces (a broadcast of the fixed vocabulary) and put
    together by position, in chunks first, so a very long text is not one large sort. Keys must be unique."""
    spark = encoded.sparkSession
    one = encoded.select(F.col(key).alias("key"), F.posexplode_outer(ids).alias("at", "id"))
    text = (
        one.join(F.broadcast(pieces(spark, folder)), "id", "left")
        .groupBy("key", F.floor(F.coalesce("at", F.lit(0)) / chunk).alias("part"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("hex"))
        .groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "hex"))), lambda x: x["hex"]), "").alias("hex"))
    )
    return text.select(F.col("key").alias(key), F.decode(F.unhex("hex"), "UTF-8").alias("text"))
