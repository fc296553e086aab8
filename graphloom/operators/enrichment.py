"""Annotations of symbols from outside: checked, merged and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SUMMARY, MAX_TAGS = 500, 10


def parse_annotations(documents: DataFrame) -> DataFrame:
    """Annotations from JSON texts `{"symbol": …, "summary": …}`; what is no such object has a null symbol."""
    j = F.from_json("text", "struct<symbol: string, summary: string, broken: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    whole = documents.select("doc_id", "text", j.alias("j")).withColumn("j", F.when(F.col("j.broken").isNull() & F.col("text").rlike(r"(?s)^[ \t\r\n]*\{.*\}[ \t\r\n]*$"), F.col("j")))
    return whole.select("doc_id", "j.symbol", "j.summary")


def merge_annotations(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Nodes with summary and tags of their annotation: summaries cut to MAX_SUMMARY characters, tags merged in any case, at most MAX_TAGS."""
    a = annotations.groupBy("id").agg(F.max(F.struct("summary", "tags")).alias("a"))
    j = nodes.join(a, "id", "left")
    lower = F.transform(F.coalesce("a.tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    merged = F.slice(F.array_distinct(F.concat(F.transform("tags", lambda t: F.lower(t)), lower)), 1, MAX_TAGS)
    return j.withColumn("summary", F.substring("a.summary", 1, MAX_SUMMARY)).withColumn("tags", F.when(F.col("a").isNull(), F.col("tags")).otherwise(merged)).drop("a")


def annotation_issues(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Annotations of unknown symbols, with too long summaries or without one, per kind."""
    known = nodes.select("id").withColumn("known", F.lit(True))
    j = annotations.join(known, "id", "left")
    issue = F.when(F.col("id").isNull(), "no_symbol").when(F.col("known").isNull(), "unknown_symbol").when(F.coalesce(F.length(F.trim("summary")), F.lit(0)) == 0, "no_summary").when(F.length("summary") > MAX_SUMMARY, "long_summary").otherwise("ok")
    return j.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


def enrichment_status(nodes: DataFrame) -> DataFrame:
    """Per repository: symbols with and without documentation, and files that have any."""
    has = F.coalesce(F.length(F.trim("docstring")), F.lit(0)) > 0
    return nodes.where("repo_id is not null and type not in ('file', 'module')").groupBy("repo_id").agg(F.count("*").alias("n_symbols"), F.count_if(has).alias("n_documented"), F.count_distinct(F.when(has, F.col("file_path"))).alias("n_files_documented"))
