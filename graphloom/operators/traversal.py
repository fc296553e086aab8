"""Level-synchronous breadth-first traversal from many starts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.runtime import cut


def key(c: str) -> Column:
    """16 bytes that stand for a long id in joins and checkpoints; two of n ids share one with a probability of about n*n / 2**129."""
    return F.unhex(F.md5(F.col(c)))


def names(*ids: DataFrame) -> DataFrame:
    """The ids of some tables once each, with their keys."""
    out = ids[0].select("id")
    for more in ids[1:]:
        out = out.unionByName(more.select("id"))
    return out.where("id is not null").distinct().select(key("id").alias("key_"), F.col("id").alias("name_"))


def named(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The ids back in place of their keys."""
    return df.join(ids.select(F.col("key_").alias(column), "name_"), column).drop(column).withColumnRenamed("name_", column)


def steps(edges: DataFrame, direction: str, types: tuple[str, ...] | None = dims.TRAVERSED, min_confidence: float = 0.0, follow_unresolved: bool = False) -> DataFrame:
    """The pairs (at, to, confidence) that a traversal may take; without types, over edges of every type."""
    e = edges.where(F.col("confidence") >= min_confidence)
    if types is not None:
        e = e.where(F.col("type").isin(*types))
    if not follow_unresolved:
        e = e.where(~dims.blocks_traversal(F.col("resolution")))
    a, b = ("target", "source") if direction == "incoming" else ("source", "target")
    both = e.select(F.col(a).alias("at"), F.col(b).alias("to"), "confidence")
    if direction == "both":
        both = both.unionByName(e.select(F.col("target").alias("at"), F.col("source").alias("to"), "confidence"))
    return both.groupBy("at", "to").agg(F.max("confidence").alias("confidence"))


def reach(starts: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """Everything within `depth` steps of each start: root_id, id, distance, confidence.

    `starts` has root_id. One join per level for all starts together, with what was visited
    taken out by an anti join, so cycles end. The confidence is that of the best edge from the
    level before. Starts are not in their own result; depth 0 gives none. Deep traversals cut
    their lineage at each level.
    """
    frontier = starts.select("root_id", F.col("root_id").alias("id")).where("root_id is not null").distinct()
    visited = frontier
    levels = []
    for d in range(1, depth + 1):
        step = frontier.join(links, frontier["id"] == links["at"]).groupBy("root_id", F.col("to").alias("id")).agg(F.max("confidence").alias("confidence"))
        step = step.join(visited, ["root_id", "id"], "left_anti").withColumn("distance", F.lit(d))
        if depth > 1:
            step = cut(step)
        levels.append(step)
        frontier = step.select("root_id", "id")
        visited = visited.unionByName(frontier)
    out = levels[0] if levels else frontier.withColumn("confidence", F.lit(0.0)).withColumn("distance", F.lit(0)).limit(0)
    for step in levels[1:]:
        out = out.unionByName(step)
    return out.select("root_id", "id", "distance", "confidence")


def subgraph(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Edges whose ends both lie within `depth` steps of a start in either direction, per start; edges of every type lead on.

    Each edge is matched from the end that fewer starts have near, so a hub is not multiplied by
    all that refers to it. Ids travel as keys until the end.
    """
    ids = cut(names(starts.select(F.col("root_id").alias("id")), edges.select(F.explode(F.array("source", "target")).alias("id"))))
    e = cut(edges.select(key("source").alias("source"), key("target").alias("target"), "type", "confidence", "resolution"))
    roots = starts.select(key("root_id").alias("root_id"))
    near = cut(reach(roots, steps(e, "both", None, follow_unresolved=True), depth).select("root_id", "id").unionByName(roots.select("root_id", F.col("root_id").alias("id"))).distinct())
    n = near.groupBy("id").agg(F.count("*").alias("n"))
    e = e.select("source", "target", "type").join(n.select(F.col("id").alias("source"), F.col("n").alias("n_source")), "source").join(n.select(F.col("id").alias("target"), F.col("n").alias("n_target")), "target")
    e = cut(e)
    parts = []
    for a, b, fewer in (("source", "target", "n_source <= n_target"), ("target", "source", "n_source > n_target")):
        at = e.where(fewer).join(near.select("root_id", F.col("id").alias(a)), a)
        parts.append(at.join(near.select("root_id", F.col("id").alias(b)), ["root_id", b], "left_semi").select("root_id", "source", "target", "type"))
    out = parts[0].unionByName(parts[1])
    for c in ("root_id", "source", "target"):
        out = named(out, ids, c)
    return out.select("root_id", "source", "target", "type")


def callers_with_missing(starts: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 1, min_confidence: float = dims.MEDIUM) -> DataFrame:
    """Callees by calls of some confidence; those that are no node of the graph are marked and not expanded."""
    links = steps(edges, "outgoing", ("calls",), min_confidence, follow_unresolved=True)
    known = nodes.select(F.col("id").alias("to"), F.lit(True).alias("known"))
    inside = links.join(known, "to", "left_semi")
    found = reach(starts, inside, depth)
    at = found.where(F.col("distance") < depth).select("root_id", "id", "distance").unionByName(starts.select("root_id", F.col("root_id").alias("id"), F.lit(0).alias("distance")))
    missing = at.join(links.join(known, "to", "left_anti"), F.col("id") == F.col("at")).groupBy("root_id", F.col("to").alias("id")).agg((F.min("distance") + 1).alias("distance"), F.max("confidence").alias("confidence"))
    return found.withColumn("known", F.lit(True)).unionByName(missing.withColumn("known", F.lit(False)))
