"""Tests that cover symbols, by the confidence of tested_by edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dims

COVERED = 0.75


def coverage_buckets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per production symbol: high (a test of at least COVERED), low (weaker), unknown (only worthless ones), none."""
    symbols = nodes.where(F.col("type").isin(*dims.PRODUCTION_TYPES) & ~dims.is_coverage_test_path(F.col("file_path"))).select("id", "type", "file_path", "repo_id")
    best = edges.where("type = 'tested_by'").groupBy(F.col("source").alias("id")).agg(F.max("confidence").alias("best"), F.count_distinct("target").alias("n_tests"))
    bucket = F.when(F.col("best") >= COVERED, "high").when(F.col("best") > 0, "low").when(F.col("best").isNotNull(), "unknown").otherwise("none")
    return symbols.join(best, "id", "left").select("id", "type", "file_path", "repo_id", bucket.alias("bucket"), F.coalesce("n_tests", F.lit(0)).alias("n_tests"))


def coverage_by_file(buckets: DataFrame) -> DataFrame:
    """Files with symbols that no test covers, or with none that a test covers."""
    b = F.col("bucket")
    per_file = buckets.where("file_path is not null").groupBy("file_path").agg(F.count("*").alias("n_symbols"), F.count_if(b == "high").alias("n_high"), F.count_if(b == "low").alias("n_low"), F.count_if(b.isin("none", "unknown")).alias("n_uncovered"))
    return per_file.where("n_uncovered > 0 or n_high + n_low = 0")


def coverage_summary(buckets: DataFrame) -> DataFrame:
    """Per repository the share of each bucket and how far the figures can be trusted."""
    b = F.col("bucket")
    s = buckets.where("repo_id is not null").groupBy("repo_id").agg(F.count("*").alias("n"), *[F.count_if(b == k).alias(f"n_{k}") for k in ("high", "low", "unknown", "none")])
    level = (
        F.when(F.col("n_high") * 2 >= F.col("n"), "high")
        .when((F.col("n_high") > 0) | (F.col("n_low") > 0) & ((F.col("n_high") + F.col("n_low")) * 10 >= F.col("n") * 3), "medium")
        .when((F.col("n_low") > 0) | (F.col("n_unknown") > 0), "low")
        .otherwise("unknown")
    )
    return s.withColumn("confidence", level)


def coverage_signal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: symbols by the class of their best test, and whether tests are linked at all."""
    tests = nodes.where(dims.is_coverage_test_path(F.col("file_path"))).groupBy("repo_id").agg(F.count_distinct("file_path").alias("n_test_files"))
    src = nodes.where("repo_id is not null").select(F.col("id").alias("source"), "repo_id")
    linked = edges.where("type = 'tested_by'").join(src, "source").groupBy("repo_id").agg(F.count_distinct("source").alias("n_tested"), F.count_distinct(F.when(F.col("confidence") >= COVERED, F.col("source"))).alias("n_high"))
    repos = nodes.where("repo_id is not null").select("repo_id").distinct()
    j = repos.join(tests, "repo_id", "left").join(linked, "repo_id", "left").fillna(0, ["n_test_files", "n_tested", "n_high"])
    status = F.when(F.col("n_tested") == 0, F.when(F.col("n_test_files") == 0, "unknown").otherwise("incomplete")).when(F.col("n_high") == 0, "low_confidence").when(F.col("n_high") * 2 >= F.col("n_tested"), "ok").otherwise("low_confidence")
    return j.withColumn("status", status)
