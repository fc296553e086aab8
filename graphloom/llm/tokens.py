"""Token ids of the corpus by a public byte-level vocabulary, and their number."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import load
from graphloom.runtime import portable, spread

VOCABULARY = os.path.join(os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def _shipped(spark: SparkSession, vocabulary: str):
    """The vocabulary file, read on the driver; its size is fixed (under 1 MB)."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_corpus(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of each document, without special tokens (their strings are ordinary text).

    A null text and an empty one have an empty list; a blank one has the ids of its blanks. Each
    row gives a row, also repeated ones and those without doc_id.
    """
    shipped = _shipped(docs.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(shipped.value).encode
        for b in batches:
            ids = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = pa.array([i for x in ids for i in x], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    return spread(docs.select("doc_id", "text")).mapInArrow(portable(work), "doc_id bigint, ids array<int>")


def decode_corpus(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of each row of ids, by the incremental decoder; no ids give an empty text, null ids none.

    An id that the vocabulary lacks fails the job.
    """
    shipped = _shipped(encoded.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(shipped.value).decode
        for b in batches:
            texts = [None if ids is None else "".join(decode(ids)) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(portable(work), "doc_id bigint, text string")


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source and n_tokens of each document."""
    shipped = _shipped(docs.sparkSession, vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(shipped.value).encode
        for b in batches:
            n = [len(encode(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return spread(docs.select("doc_id", "source", "text")).mapInArrow(portable(work), "doc_id bigint, source string, n_tokens bigint")


def token_stats(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents and tokens per source."""
    return count_tokens(docs, vocabulary).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
