"""Whether a stored graph is whole, what of it can be repaired, and what a loss means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.functions.keys import EDGE_TYPES, clean_id, edge_type, node_type

SCHEMA_VERSION = 2
ORPHANS, EXTERNALS, LOW = 0.5, 0.3, 0.5  # shares above which a warning is due


def graph_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rules over the whole graph: rule, value, level (fatal, warning, ok)."""
    touched = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("t", F.lit(1))
    n = nodes.join(touched, "id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("t").isNull()).alias("alone"))
    e = edges.agg(F.count("*").alias("m"), F.count_if(F.startswith("target", F.lit("external:"))).alias("ext"), F.count_if(F.col("confidence") < dims.MEDIUM).alias("low"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(b, F.lit(1)), 4)
    rule = lambda name, value, level: F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value"), level.alias("level"))
    above = lambda v, limit: F.when(v > limit, "warning").otherwise("ok")
    o, x, lo = share("alone", "n"), share("ext", "m"), share("low", "m")
    rules = [rule("no_nodes", F.col("n"), F.when(F.col("n") == 0, "fatal").otherwise("ok")), rule("orphan_ratio", o, above(o, ORPHANS)), rule("external_ratio", x, above(x, EXTERNALS)), rule("low_confidence_ratio", lo, above(lo, LOW))]
    return n.join(F.broadcast(e), F.lit(True)).select(F.inline(F.array(*rules)))  # one row each


def repair(nodes: DataFrame, edges: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivered rows as far as they can be mended: ids, types and paths in canonical form, confidence clamped, tags filled, dangling and unknown edges left out.

    An `external:` target is a legal one. Refuses a graph without nodes.
    """
    if nodes.isEmpty():
        raise ValueError("a graph without nodes can't be repaired")
    n = nodes.withColumn("id", clean_id(F.col("id"))).where("id is not null").withColumn("type", node_type(F.col("type"))).withColumn("file_path", F.replace("file_path", F.lit("\\"), F.lit("/"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    known = n.select("id").unionByName(external.select(clean_id(F.col("id")).alias("id"))).distinct()
    e = edges.withColumn("source", clean_id(F.col("source"))).withColumn("target", clean_id(F.col("target"))).withColumn("type", edge_type(F.col("type"))).withColumn("confidence", F.least(F.greatest(F.coalesce("confidence", dims.default_confidence(F.col("metadata.resolution"))), F.lit(0.0)), F.lit(1.0)))
    e = e.where(F.col("type").isin(*EDGE_TYPES)).join(known.withColumnRenamed("id", "source"), "source", "left_semi")
    legal = F.startswith("target", F.lit("external:"))
    e = e.where(legal).unionByName(e.where(~legal).join(known.withColumnRenamed("id", "target"), "target", "left_semi").select(*e.columns))
    return n, e.select(*edges.columns)


def assessment(breakdown: DataFrame) -> DataFrame:
    """What each kind of dropped edge means for answers, and what to do: reason, n, severity, action."""
    r = F.col("reason")
    meaning = F.when(r.isin("missing_source", "missing_both"), "callers are lost").when(r == "missing_target", "callees are lost").when(r == "invalid_type", "relations are not traversed").otherwise("none")
    action = F.when(r.startswith("missing"), "index the repository again").when(r == "invalid_type", "add the type to the aliases").otherwise("nothing")
    return breakdown.where("action = 'dropped'").select("reason", "n", meaning.alias("meaning"), action.alias("next"), F.when(F.col("n") > 100, "high").when(F.col("n") > 10, "medium").otherwise("low").alias("severity"))


def artifact_counts(nodes: DataFrame, edges: DataFrame, terms: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Counts across the artifacts of a store: artifact, n, and for full text and fingerprints how many nodes or files they lack."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("artifact"), "n")
    ids = nodes.where("name is not null or qualified_name is not null or docstring is not null").select("id")
    lacking = ids.join(terms.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("nodes_without_terms").alias("artifact"), "n")
    files = nodes.where("type = 'file' and file_path is not null").select("file_path").distinct()
    unprinted = files.join(fingerprints.select("file_path").distinct(), "file_path", "left_anti").agg(F.count("*").alias("n")).select(F.lit("files_without_fingerprint").alias("artifact"), "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges")).unionByName(lacking).unionByName(unprinted)


def schema_status(version: int | None) -> str:
    return "missing" if version is None else "current" if version == SCHEMA_VERSION else "older" if version < SCHEMA_VERSION else "newer"
