"""What is wrong with delivered nodes and edges, in the order in which it is judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.functions.keys import EDGE_TYPES, NODE_TYPES, clean_id, edge_type, node_type, strip

DROPPED, CORRECTED, WARNING = "dropped", "corrected", "warning"


def edge_issues(edges: DataFrame, nodes: DataFrame, external: DataFrame) -> DataFrame:
    """Issues of each edge (redelivered rows once): id, reason, action.

    Missing ends come before the type, so an edge that has both counts as missing; what is
    dropped is not judged further. Then come aliases of the type, confidence outside of [0, 1] or
    missing, and resolutions outside of their domain.
    """
    known = nodes.select(clean_id(F.col("id")).alias("id")).unionByName(external.select(clean_id(F.col("id")).alias("id"))).where("id is not null").distinct()
    e = edges.select(
        F.col("id").alias("edge_id"), clean_id(F.col("source")).alias("source"), clean_id(F.col("target")).alias("target"), F.lower(strip(F.col("type"))).alias("raw"), edge_type(F.col("type")).alias("type"), "confidence", F.col("metadata.resolution").alias("resolution"),
        (F.contains("source", F.lit("\\")) | F.contains("target", F.lit("\\"))).alias("backslash"),
    ).groupBy("edge_id").agg(*[F.max(c).alias(c) for c in ("source", "target", "raw", "type", "confidence", "resolution", "backslash")])
    s = known.select(F.col("id").alias("source"), F.lit(True).alias("has_source"))
    t = known.select(F.col("id").alias("target"), F.lit(True).alias("has_target"))
    j = e.join(s, "source", "left").join(t, "target", "left")
    no_s, no_t = F.col("has_source").isNull(), F.col("has_target").isNull()
    drop = F.when(no_s & no_t, "missing_both").when(no_s, "missing_source").when(no_t, "missing_target").when(~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False)), "invalid_type")
    issue = lambda cond, reason, action: F.when(cond, F.struct(F.lit(reason).alias("reason"), F.lit(action).alias("action")))
    known_resolutions = [r[0] for r in dims.resolution_rows()]
    kept = [
        issue(F.col("raw") != F.col("type"), "type_alias", CORRECTED),
        issue(F.col("backslash"), "backslash_path", CORRECTED),
        issue((F.col("confidence") > 1) | (F.col("confidence") < 0), "confidence_clamped", CORRECTED),
        issue(F.col("confidence").isNull(), "confidence_missing", CORRECTED),
        issue(F.col("resolution").isNull(), "resolution_missing", WARNING),
        issue(~F.col("resolution").isin(*known_resolutions), "resolution_unknown", WARNING),
    ]
    found = F.when(drop.isNotNull(), F.array(F.struct(drop.alias("reason"), F.lit(DROPPED).alias("action")))).otherwise(F.filter(F.array(*kept), lambda x: x.isNotNull()))
    return j.select(F.lit("edge").alias("entity"), F.col("edge_id").alias("id"), F.inline(found))


def node_issues(nodes: DataFrame) -> DataFrame:
    """Issues of each node id: alias or unknown types, paths with backslashes, missing or reversed locations."""
    n = nodes.select(
        clean_id(F.col("id")).alias("id"), F.lower(strip(F.col("type"))).alias("raw"), node_type(F.col("type")).alias("type"), F.contains("file_path", F.lit("\\")).alias("backslash"), (F.col("location.line_start") > F.col("location.line_end")).alias("reversed"),
        F.col("tags").isNull().alias("no_tags"),
    ).where("id is not null")
    flags = {
        "type_alias": (F.col("raw") != F.col("type"), CORRECTED), "type_unknown": (~F.col("type").isin(*NODE_TYPES), WARNING), "backslash_path": (F.col("backslash"), CORRECTED),
        "location_reversed": (F.col("reversed"), CORRECTED), "tags_missing": (F.col("no_tags"), CORRECTED),
    }
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("reason"), F.lit(a).alias("action"))) for k, (c, a) in flags.items()]), lambda x: x.isNotNull())
    return n.select(F.lit("node").alias("entity"), "id", F.inline(found)).distinct()


def breakdown(issues: DataFrame) -> DataFrame:
    """Number of issues per reason with a first and a last example; counted map-side."""
    return issues.groupBy("entity", "reason", "action").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def health(issues: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: dropped edges against all, what was corrected, and the status."""
    total = edges.agg(F.count_distinct("id").alias("n_edges"))
    e = F.col("entity") == "edge"
    s = issues.agg(F.count_if(e & (F.col("action") == DROPPED)).alias("n_dropped"), F.count_if(F.col("action") == CORRECTED).alias("n_corrected"), F.count_if(F.col("action") == WARNING).alias("n_warnings"))
    out = total.join(F.broadcast(s), F.lit(True))  # one row each
    status = F.when(F.col("n_edges") == 0, "error").when((F.col("n_dropped") > 0) | (F.col("n_warnings") > 0), "warning").otherwise("ok")
    return out.withColumn("dropped_ratio", F.round(F.col("n_dropped") / F.greatest("n_edges", F.lit(1)), 4)).withColumn("status", status)


def isolated_ratio(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per type: nodes that no edge touches."""
    touched = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    n = nodes.join(touched.withColumn("touched", F.lit(1)), "id", "left")
    return n.groupBy("type").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("touched").isNull()).alias("n_isolated")).withColumn("ratio", F.round(F.col("n_isolated") / F.col("n_nodes"), 4))
