"""Encode a corpus with a byte-level BPE vocabulary, each distinct word once.

An Arrow step cuts documents into pre-tokens and packs runs of documents into
blocks of bounded size: a row holds the block's keys, its distinct pre-tokens,
and the positions of all its pre-tokens among these as one buffer. Only
(block, index, word) rows meet in the global word shuffle; the distinct words
are encoded once, their ids joined back, collected per block and placed by
position, again for a whole block at once.

Defined cases: a null or empty text gives an empty list; repeated rows give a
row each; an empty table gives no rows; a text of any length stands in one
block; columns of the input besides the key and the text are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.pretokens import blocks
from lodestone.session import materialize


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def load_encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block of documents; an index takes two bytes where the block's words are few enough."""
    for batch in batches:
        for a, b, counts, words in blocks(batch.column(1)):
            coded = words.dictionary_encode()
            seq = coded.indices.to_numpy().astype("<u2" if len(coded.dictionary) <= 1 << 16 else "<u4")
            one = {
                "block": pa.array([uuid.uuid4().hex]),
                "keys": pa.ListArray.from_arrays([0, b - a], batch.column(0).slice(a, b - a)),
                "counts": pa.array([counts.tobytes()], pa.binary()),
                "seq": pa.array([seq.tobytes()], pa.binary()),
                "words": pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary),
            }
            yield pa.RecordBatch.from_arrays(list(one.values()), names=list(one))


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """Keys, pre-tokens a document, word indexes and the table of what the words became, of each block."""
    for batch in batches:
        keys, counts, seq, table = (batch.column(k) for k in range(4))
        for i in range(batch.num_rows):
            n = np.frombuffer(counts[i].as_buffer(), np.int64)
            raw = seq[i].as_buffer()
            wide = n.sum() * 4 == raw.size
            yield keys[i].values, n, np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.int64), table[i].values


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _place_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, counts, seq, table in _each_block(batches):
        if len(seq):
            sizes = np.asarray(table.value_lengths(), dtype=np.int64)
            first = np.cumsum(sizes) - sizes
            own = sizes[seq]
            ends = np.cumsum(own)
            at = np.repeat(first[seq] - ends + own, own) + np.arange(ends[-1])
            flat, lengths = np.asarray(table.flatten())[at], _sums(own, counts)
        else:
            flat, lengths = np.empty(0, np.int32), counts
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["key", "ids"])


def _place_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, counts, seq, table in _each_block(batches):
        own = np.asarray(table, dtype=np.int64)[seq] if len(seq) else seq
        yield pa.RecordBatch.from_arrays([keys, pa.array(_sums(own, counts))], names=["key", "n"])


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """``word`` -> ``word, ids``: one encoding per row of a distinct word list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(vocabulary)._encode_single_piece
        for batch in batches:
            ids = [encode(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def _through_words(docs: DataFrame, vocabulary: str, key: str, text: str, became: Column, place: Callable, result: str) -> DataFrame:
    """``place`` over blocks joined with ``became`` of their words' ``ids``."""
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    cut = materialize(source.mapInArrow(_cut, f"block string, keys array<{kind}>, counts binary, seq binary, words array<string>"), "pretokens")
    used = cut.select("block", F.posexplode("words").alias("i", "word"))
    coded = encode_words(used.select("word").distinct(), vocabulary).select("word", became.alias("v"))
    tables = (
        used.join(coded, "word")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("t"))
        .select("block", F.transform("t", lambda x: x["v"]).alias("t"))
    )
    placed = cut.select("block", "keys", "counts", "seq").join(tables, "block", "left").select("keys", "counts", "seq", "t")
    return placed.mapInArrow(place, f"key {kind}, {result}").withColumnRenamed("key", key)


def encode_corpus(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` for every row of ``docs``, without special tokens."""
    return _through_words(docs, vocabulary, key, text, F.col("ids"), _place_ids, "ids array<int>")


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens`` for every row of ``docs``: as ``encode_corpus``, but only the words' numbers of ids travel."""
    return _through_words(docs, vocabulary, key, text, F.size("ids"), _place_sizes, "n bigint").withColumnRenamed("n", "n_tokens")


def decode_corpus(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text``: joins the table of token bytes and strings them together.

    The table has a row per token of the vocabulary (about fifty thousand
    short strings, fixed by the file), so it is broadcast.
    """
    spark = encoded.sparkSession
    with open(vocabulary, "rb") as f:
        table = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    tokens = spark.createDataFrame(table, "id int, bytes binary")
    numbered = encoded.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("r"), F.col(ids).alias("own"))
    rows = numbered.select("key", "r", F.posexplode_outer("own").alias("p", "id"))
    return (
        rows.join(F.broadcast(tokens), "id", "left")
        .groupBy("r", "key")
        .agg(F.sort_array(F.collect_list(F.struct("p", F.hex("bytes").alias("h")))).alias("t"))
        .select(
            F.col("key").alias(key),
            F.decode(F.unhex(F.array_join(F.transform("t", lambda x: x["h"]), "")), "UTF-8").alias("text"),
        )
    )
