"""Reading source trees and graphs, writing graphs."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.ingest.build import facts, graph_of, patch_graph

GRAPH_JSON = (
    "nodes array<struct<id: string, type: string, name: string, file_path: string, module: string, qualified_name: string, signature: string, docstring: string, tags: array<string>>>, "
    "edges array<struct<source: string, target: string, type: string, confidence: double, metadata: struct<call_expr: string, resolution: string>>>"
)


def _inside(root: str) -> list[str]:
    """Links of a local tree that lead out of it; Spark follows links without showing them."""
    real, out = os.path.realpath(root), []
    for folder, dirs, names in os.walk(root):
        for n in [*dirs, *names]:
            p = os.path.join(folder, n)
            if os.path.islink(p) and not os.path.realpath(p).startswith(real + os.sep):
                out.append(os.path.relpath(p, root))
    return out


def scan_tree(spark: SparkSession, root: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Source files below a folder: file_path relative to it, repo_id, modification_time, length, content.

    Extensions of unknown languages, excluded folders and (in a local tree) links that lead out of
    the root are left out. The filter on paths is applied before contents are read on.
    """
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + base.split("://", 1)[-1] + "\\E/", "")
    out = df.select(relative.alias("file_path"), F.lit(os.path.basename(base)).alias("repo_id"), F.col("modificationTime").alias("modification_time"), "length", "content", F.col("modificationTime").alias("loaded_at"))
    out = out.where(~dims.is_excluded(F.col("file_path")) & dims.language(F.col("file_path")).isNotNull())
    if languages:
        out = out.where(dims.language(F.col("file_path")).isin(*languages))
    for p in _inside(base) if os.path.isdir(base) else []:
        out = out.where((F.col("file_path") != p) & ~F.startswith("file_path", F.lit(p + "/")))
    return out


def _path(spark: SparkSession, path: str):
    """A path on whatever storage its scheme names, with that storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, folder: str) -> dict | None:
    """Which version of a stored graph counts, and the last batch in it; None if there is none."""
    p, fs = _path(spark, f"{folder.rstrip('/')}/CURRENT")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _point(spark: SparkSession, folder: str, content: dict) -> None:
    """Replace the pointer: written beside it, then renamed over it in one step."""
    staged, fs = _path(spark, f"{folder.rstrip('/')}/CURRENT.{content['version']}.next")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    target, _ = _path(spark, f"{folder.rstrip('/')}/CURRENT")
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(target), over)


def write_version(spark: SparkSession, folder: str, batch: int | None = None, keep: int = 2, **tables: DataFrame) -> int:
    """Store the tables as the next version and point to it; readers see the version before or this one.

    Works on any storage that Hadoop's FileSystem knows. A step that dies leaves at most a version
    that nothing points to. Of older versions `keep - 1` stay for readers that began before.
    """
    now = pointer(spark, folder)
    version = (now["version"] if now else 0) + 1
    for name, df in tables.items():
        out = df.sortWithinPartitions("target") if name == "edges" and "target" in df.columns else df
        out.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/v{version:08d}/{name}")
    _point(spark, folder, {"version": version, "batch": batch})
    for old in range(max(1, version - keep - 8), version - keep + 1):
        p, fs = _path(spark, f"{folder.rstrip('/')}/v{old:08d}")
        fs.delete(p, True)
    return version


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    at = pointer(spark, folder)
    if at is None:
        raise FileNotFoundError(f"no graph in {folder}")
    return spark.read.parquet(f"{folder.rstrip('/')}/v{at['version']:08d}/{name}")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the version that counts."""
    return read_table(spark, folder, "nodes"), read_table(spark, folder, "edges")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, facts: DataFrame | None = None, batch: int | None = None) -> None:
    """Replace the graph: edges sorted by target within files, so that lookups skip row groups."""
    more = {} if facts is None else {"facts": facts}
    write_version(nodes.sparkSession, folder, batch, nodes=nodes, edges=edges, **more)


def clear_graph(spark: SparkSession, folder: str) -> None:
    """An empty graph as the next version; the schema stays."""
    nodes, edges = read_graph(spark, folder)
    write_graph(nodes.limit(0), edges.limit(0), folder)


def write_buckets(edges: DataFrame, name: str, buckets: int = 64) -> None:
    """A table of edges bucketed by target; traversals that join on it again don't shuffle it."""
    edges.write.mode("overwrite").bucketBy(buckets, "target").sortBy("target").saveAsTable(name)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file, one JSON document; unreadable documents give no rows."""
    g = spark.read.schema(GRAPH_JSON).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return g.select(F.inline("nodes")), g.select(F.inline("edges"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def apply_files(spark: SparkSession, folder: str, files: DataFrame, removed: DataFrame, batch: int | None = None) -> bool:
    """One incremental step on a stored graph; False if the batch is in it already."""
    at = pointer(spark, folder)
    if at is not None and batch is not None and at["batch"] is not None and at["batch"] >= batch:
        return False
    if at is None:
        f = facts(files)
        nodes, edges = graph_of(f)
    else:
        nodes, edges, f = patch_graph(*read_graph(spark, folder), read_table(spark, folder, "facts"), files, removed)
    write_version(spark, folder, batch, nodes=nodes, edges=edges, facts=f)
    return True
