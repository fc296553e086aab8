"""Keyed upserts, change classification and what must be indexed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.keys import clean_path

REBUILD_FILES, REBUILD_SHARE = 30, 0.3
HASHES = ("structural_hash", "symbols_hash", "imports_hash", "calls_hash")


def latest_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """One row per repository, snapshot and path: the one that arrived last."""
    f = fingerprints.select("repo_id", "snapshot_no", clean_path(F.col("file_path")).alias("file_path"), *[F.lower(c).alias(c) for c in ("sha256", *HASHES)], "loaded_at")
    best = f.where("repo_id is not null and file_path is not null").groupBy("repo_id", "snapshot_no", "file_path").agg(F.max(F.struct("loaded_at", "sha256", *HASHES)).alias("r"))
    return best.select("repo_id", "snapshot_no", "file_path", "r.sha256", *[f"r.{h}" for h in HASHES])


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """NONE, COSMETIC, STRUCTURAL, ADDED or DELETED per repository and path."""
    c, s = current.drop("snapshot_no").alias("c"), stored.drop("snapshot_no").alias("s")
    j = c.join(s, (F.col("c.repo_id") == F.col("s.repo_id")) & (F.col("c.file_path") == F.col("s.file_path")), "full")
    moved = F.lit(False)
    for h in HASHES:
        moved = moved | ~F.col(f"c.{h}").eqNullSafe(F.col(f"s.{h}"))
    change = (
        F.when(F.col("s.file_path").isNull(), "ADDED")
        .when(F.col("c.file_path").isNull(), "DELETED")
        .when(F.col("c.sha256").eqNullSafe(F.col("s.sha256")), "NONE")
        .when(moved, "STRUCTURAL")
        .otherwise("COSMETIC")
    )
    return j.select(F.coalesce("c.repo_id", "s.repo_id").alias("repo_id"), F.coalesce("c.file_path", "s.file_path").alias("file_path"), change.alias("change"))


def last_two(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last snapshot of each repository and the one before it."""
    f = latest_fingerprints(fingerprints)
    nos = f.select("repo_id", "snapshot_no").distinct().withColumn("back", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("snapshot_no"))))
    pick = lambda k: f.join(nos.where(F.col("back") == k).drop("back"), ["repo_id", "snapshot_no"])
    return pick(1), pick(2)


def plan(changes: DataFrame) -> DataFrame:
    """Per repository: how many files changed how, and whether to index everything again."""
    c = F.col("change")
    s = changes.groupBy("repo_id").agg(F.count("*").alias("n_files"), *[F.count_if(c == k).alias(f"n_{k.lower()}") for k in ("NONE", "COSMETIC", "STRUCTURAL", "ADDED", "DELETED")])
    touched = F.col("n_structural") + F.col("n_added") + F.col("n_deleted")
    mode = F.when(touched == 0, "skip").when((touched > REBUILD_FILES) | (touched > REBUILD_SHARE * F.col("n_files")), "full").otherwise("incremental")
    return s.withColumn("mode", mode)


def dependents(changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that import something in a file that changed in structure or went, one hop."""
    files = nodes.where("file_path is not null").select("id", "file_path")
    changed = changes.where(F.col("change").isin("STRUCTURAL", "DELETED")).select("file_path").distinct()
    targets = files.join(changed, "file_path", "left_semi").select(F.col("id").alias("target"))
    sources = files.select(F.col("id").alias("source"), "file_path")
    hit = edges.where("type = 'imports'").join(targets, "target", "left_semi").join(sources, "source").select("file_path").distinct()
    return hit.join(changed, "file_path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def remove_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without what lies in the files, and without edges that touched it."""
    gone = nodes.join(files, "file_path", "left_semi").select("id")
    kept = nodes.join(gone, "id", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept, e.select(*edges.columns)
