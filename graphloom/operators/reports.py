"""Reports that compose the graph, its sources and the stored state of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.operators.graph import degrees

PER_FILE, NEIGHBOURS = 20, 5


def rank_symbols(nodes: DataFrame, k: int = 8) -> DataFrame:
    """The k symbols of each file that tell most about it: documentation 10, two per tag, public 3, signature 2."""
    n = nodes.where(~F.col("type").isin("file", "module", "external_symbol") & F.col("file_path").isNotNull())
    has = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0
    score = F.when(has("docstring"), 10).otherwise(0) + 2 * F.size("tags") + F.when(dims.visibility(F.col("name")) == "public", 3).otherwise(0) + F.when(has("signature"), 2).otherwise(0)
    w = Window.partitionBy("file_path").orderBy(F.desc("score"), "id")
    return n.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("file_path", "rank", "id", "score")


def file_roles(nodes: DataFrame) -> DataFrame:
    """What each file is for, by its path and the tags of its symbols."""
    n = nodes.where("file_path is not null")
    tags = n.groupBy("file_path").agg(*[F.max(F.array_contains("tags", t).cast("int")).alias(t) for t in ("model", "config", "store", "route")], F.count_if(~F.col("type").isin("file", "module")).alias("n_symbols"))
    p = F.col("file_path")
    role = (
        F.when(dims.is_test_path(p), "test").when(F.col("route") == 1, "api").when(F.col("model") == 1, "model").when(F.col("config") == 1, "config").when(F.col("store") == 1, "storage").when(F.col("n_symbols") == 0, "empty").otherwise(dims.layer(p))
    )
    return tags.select("file_path", role.alias("role"), "n_symbols")


def enrichment_prepare(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each file's first symbols, up to five callers and callees by confidence, as one row per symbol."""
    w = Window.partitionBy("file_path").orderBy("line_start", "id")
    s = nodes.where(F.col("type").isin("function", "method", "class") & F.col("file_path").isNotNull()).withColumn("at", F.row_number().over(w)).where(F.col("at") <= PER_FILE).select("id", "file_path", "at")

    def best(here: str, there: str, name: str) -> DataFrame:
        e = edges.where("type = 'calls'").groupBy(F.col(here).alias("id"), F.col(there).alias("other")).agg(F.max("confidence").alias("c"))
        top = e.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "other"))).where(F.col("rn") <= NEIGHBOURS)
        return top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "other"))), lambda x: x["other"]), ",").alias(name))  # at most five

    return s.join(best("target", "source", "callers"), "id", "left").join(best("source", "target", "callees"), "id", "left")


def scan_overview(nodes: DataFrame, edges: DataFrame, k: int = 15, keep: int = 5) -> DataFrame:
    """The k files of highest degree, then of these the first that are no tests."""
    f = nodes.where("file_path is not null").select("id", "file_path").join(degrees(edges), "id").groupBy("file_path").agg(F.sum("degree").alias("degree"))
    return f.orderBy(F.desc("degree"), "file_path").limit(k).where(~dims.is_test_path(F.col("file_path"))).orderBy(F.desc("degree"), "file_path").limit(keep)


def test_files(files: DataFrame) -> DataFrame:
    """Test files per repository and language, with the first by path."""
    f = files.select("file_path", "repo_id").distinct().where(dims.is_coverage_test_path(F.col("file_path")))
    return f.groupBy("repo_id", dims.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n_files"), F.min("file_path").alias("sample"))


def index_status(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files as they are against the fingerprints of the last run, by content: unchanged, changed, added, deleted per repository."""
    now = files.groupBy("file_path").agg(F.max(F.struct("loaded_at", "content", "repo_id")).alias("f")).select("file_path", "f.repo_id", "f.content")
    was = stored.select("file_path", F.col("repo_id").alias("was_repo"), F.col("sha256").alias("was"), F.lit(True).alias("stored"))
    j = now.join(was, "file_path", "full")
    state = F.when(F.col("stored").isNull(), "added").when(F.col("repo_id").isNull(), "deleted").when(F.sha2("content", 256) == F.col("was"), "unchanged").otherwise("changed")
    return j.groupBy(F.coalesce("repo_id", "was_repo").alias("repo_id"), state.alias("state")).agg(F.count("*").alias("n_files"))


def freshness(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Per repository: files edited more than a second after what the index recorded, never recorded, or fresh. Times that are unknown are told apart."""
    now = files.groupBy("file_path").agg(F.max("modification_time").alias("t"), F.max("repo_id").alias("repo_id"))
    was = stored.select("file_path", "mtime", F.lit(True).alias("stored"))
    j = now.join(was, "file_path", "left")
    state = F.when(F.col("stored").isNull(), "pending").when(F.col("t").isNull() | F.col("mtime").isNull(), "unknown").when(F.unix_micros(F.col("t").cast("timestamp")) / 1e6 - F.col("mtime") > 1, "edited_recently").otherwise("fresh")
    return j.groupBy("repo_id", state.alias("state")).agg(F.count("*").alias("n_files"))


def stat_prefilter(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Per repository: files whose time (to a millisecond) and length are those that the index recorded, and those whose content has to be hashed. Contents are not read."""
    now = files.groupBy("file_path").agg(F.max("modification_time").alias("t"), F.max("length").alias("length"), F.max("repo_id").alias("repo_id"))
    j = now.join(stored.select("file_path", "mtime", "size"), "file_path", "left")
    same = (F.abs(F.unix_micros(F.col("t").cast("timestamp")) / 1e6 - F.col("mtime")) < 0.001) & (F.col("length") == F.col("size"))
    return j.groupBy("repo_id", F.when(same, "same_stat").otherwise("must_hash").alias("state")).agg(F.count("*").alias("n_files"))
