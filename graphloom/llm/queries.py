"""Queries of the operators for language-model data, p3, p4 and p7 to p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.handwritten import not_by_hand
from graphloom.llm.lookalike import canonical_texts, same_look_classes, same_look_pairs
from graphloom.llm.mixture import mix
from graphloom.llm.pairs import documented
from graphloom.llm.tokens import count_tokens, decode_corpus, encode_corpus, token_stats
from graphloom.llm.validity import check_syntax, failure_rates
from graphloom.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_syntax(table(spark, sf_dir, "source_files")).where("complaint is not null").select("file_path")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files")
    return failure_rates(check_syntax(files), files, table(spark, sf_dir, "repo_summary"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "nodes"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "nodes"), full=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_by_hand(table(spark, sf_dir, "source_files")).select("file_path")


def p7_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_by_hand(table(spark, sf_dir, "source_files")).groupBy("reason", "signal").agg(F.count("*").alias("n_files"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: every text encoded and decoded again; a null text gives an empty one."""
    return decode_corpus(encode_corpus(table(spark, sf_dir, "documents")))


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_stats(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(count_tokens(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(table(spark, sf_dir, "documents"))


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_texts(table(spark, sf_dir, "documents")).select("doc_id", F.col("form").alias("text"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_classes(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_rates, p4_found, p4_pairs, p7_found, p7_reasons, p8_ids, p8_decoded, p8_stats, p9_mixture, p9_shares, p10_found, p10_texts, p10_classes)}
#: Parsing, merging and Unicode data are beyond SQL: the others are tested against brute force, other libraries and round trips.
ORACLE: dict[str, str] = {"p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
