"""Visually identical text with different characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import hashed
from graphloom.llm.canonical import canonical
from graphloom.runtime import cut, portable, spread


def _spread(docs: DataFrame) -> DataFrame:
    """doc_id and text in as many tasks as the cluster has use for."""
    return spread(docs.select("doc_id", "text"))


def canonical_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and its canonical form; a null text has none. See canonical()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([canonical(t) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text", "form"])

    return _spread(docs).mapInArrow(portable(work), "doc_id bigint, text string, form string")


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, f1, f2 (digest of the form) and x1, x2 (of the text), for texts with a visible character."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def halves(s: str) -> tuple[int, int]:
            d = xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass"))
            return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)

        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = canonical(t)
                if f and not f.isspace() and i is not None:
                    out.append((i, *halves(f), *halves(t)))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "f1", "f2", "x1", "x2"])

    return _spread(docs).mapInArrow(portable(work), "doc_id bigint, f1 bigint, f2 bigint, x1 bigint, x2 bigint")


def same_look_classes(docs: DataFrame) -> DataFrame:
    """Membership: doc_id, class_id (least doc_id of what looks the same), text_id (least doc_id of the exact text), for classes of several texts.

    Exact copies are members of their text, so a text that a third of all documents repeat costs
    its rows once and no pairs.
    """
    k = cut(_keys(docs))
    texts = k.groupBy("f1", "f2", "x1", "x2").agg(F.min("doc_id").alias("text_id"))
    classes = texts.groupBy("f1", "f2").agg(F.min("text_id").alias("class_id"), F.count("*").alias("n_texts")).where("n_texts > 1").drop("n_texts")
    return k.join(classes, ["f1", "f2"]).join(texts.join(classes.select("f1", "f2"), ["f1", "f2"], "left_semi"), ["f1", "f2", "x1", "x2"]).select("doc_id", "class_id", "text_id")


def same_look_pairs(docs: DataFrame) -> DataFrame:
    """All pairs of documents whose texts differ and look the same: doc_id_a < doc_id_b.

    Documents without a visible character and null texts are in no pair, exact copies are none.
    The different texts of a form are joined first; each pair of texts is then filled with the
    documents of either side. So exact copies never meet each other, and the rows of every step
    are at most those of the result. A doc_id that occurs twice with one text counts once.
    """
    k = cut(_keys(docs).distinct())
    texts = k.select("f1", "f2", "x1", "x2").distinct()
    several = texts.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1").select("f1", "f2")
    t = cut(texts.join(several, ["f1", "f2"], "left_semi"))
    p = t.select("f1", "f2", F.struct("x1", "x2").alias("p"))
    pairs = p.join(p.withColumnRenamed("p", "q"), ["f1", "f2"]).where("p < q").select("p.x1", "p.x2", "q")
    m = k.join(t, ["f1", "f2", "x1", "x2"], "left_semi").select("x1", "x2", "doc_id")
    one = pairs.join(m.withColumnRenamed("doc_id", "i"), ["x1", "x2"]).select("i", "q.x1", "q.x2")
    both = one.join(m.withColumnRenamed("doc_id", "j"), ["x1", "x2"]).where("i <> j")
    return both.select(F.least("i", "j").alias("doc_id_a"), F.greatest("i", "j").alias("doc_id_b")).distinct()
