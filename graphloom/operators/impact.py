"""What a change of a symbol reaches, and how risky it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.operators import search
from graphloom.operators.traversal import key, named, names, reach, steps
from graphloom.runtime import cut

RISKS = ("low", "medium", "high", "critical")


def impact_pairs(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Callers and callees of each start within `depth`, by the keys of their ids: root_id, id, distance, confidence, relation.

    A class that nothing calls and that calls nothing stands for its methods. Ids travel as
    key(id), 16 bytes; named() brings them back where a result needs them.
    """
    e = cut(edges.where(F.col("type").isin(*dims.TRAVERSED)).select(key("source").alias("source"), key("target").alias("target"), "type", "confidence", "resolution"))
    starts = cut(starts.select(key("root_id").alias("root_id"), F.col("root_id").alias("name")))
    roots = starts.select("root_id")
    into, out = cut(steps(e, "incoming")), cut(steps(e, "outgoing"))
    own = [reach(roots, links, depth).withColumn("relation", F.lit(r)) for links, r in ((into, "caller"), (out, "callee"))]
    own = own[0].unionByName(own[1])
    classes = nodes.where("type = 'class'").select(F.col("id").alias("name"))
    silent = starts.join(classes, "name", "left_semi").join(own.select("root_id"), "root_id", "left_anti").select("name", F.col("root_id").alias("for_id"))
    methods = nodes.where("type = 'method'").select(key("id").alias("root_id"), F.regexp_extract("id", r"^(.*)\.[^.:/]+$", 1).alias("name"))
    stand_in = cut(methods.join(silent, "name").select("root_id", "for_id"))
    via = [reach(stand_in.select("root_id").distinct(), links, depth).withColumn("relation", F.lit(r)) for links, r in ((into, "caller"), (out, "callee"))]
    lifted = (
        via[0].unionByName(via[1])
        .join(stand_in, "root_id")
        .groupBy("for_id", "id", "relation")
        .agg(F.min(F.struct(F.least(F.col("distance") + 1, F.lit(depth)).alias("distance"), (-F.col("confidence")).alias("c"))).alias("b"))
        .select(F.col("for_id").alias("root_id"), "id", F.col("b.distance"), (-F.col("b.c")).alias("confidence"), "relation")
    )
    return own.unionByName(lifted.select(*own.columns))


def impact(starts: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, min_confidence: float = dims.MEDIUM) -> DataFrame:
    """impact_pairs() with ids, the type and file of what is reached, and whether the edge that found it makes it confirmed or possible."""
    ids = names(starts.select(F.col("root_id").alias("id")), nodes.select("id"), edges.select(F.explode(F.array("source", "target")).alias("id")))
    found = named(named(impact_pairs(starts, nodes, edges, depth), ids, "root_id"), ids, "id")
    where = nodes.select("id", F.col("type").alias("node_type"), "file_path")
    return cut(found.join(where, "id", "left").withColumn("confirmed", F.col("confidence") >= min_confidence))


def confirmed_counts(pairs: DataFrame, starts: DataFrame, min_confidence: float = dims.MEDIUM) -> DataFrame:
    """Confirmed and possible callers and callees of each start, from impact_pairs()."""
    sure = F.col("confidence") >= min_confidence
    counted = pairs.groupBy("root_id", "relation").agg(F.count_if(sure).alias("n_confirmed"), F.count_if(~sure).alias("n_possible"))
    return named(counted, names(starts.select(F.col("root_id").alias("id"))), "root_id")


def reached_nodes(pairs: DataFrame, starts: DataFrame, nodes: DataFrame, min_confidence: float = dims.MEDIUM) -> DataFrame:
    """impact_pairs() with the name of the start, and type and file of what is reached; the latter stays a key."""
    where = nodes.select(key("id").alias("id"), F.col("type").alias("node_type"), "file_path")
    found = pairs.join(where, "id", "left").withColumn("confirmed", F.col("confidence") >= min_confidence)
    return named(found, names(starts.select(F.col("root_id").alias("id"))), "root_id")


def risk(starts: DataFrame, nodes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """Risk of each start, the first rule that holds: sensitive, untested, writing and called by three: critical; sensitive, an interface or called by five: high; any caller or callee: medium; else low.

    What is sensitive or writes is told by the path, for routes also by the path that they serve.
    A symbol is tested if an edge says so, a test calls it, or a test is among its callers. A start
    that is no node has the risk `unknown`.
    """
    callable_ = F.col("node_type").isin(*dims.CALLABLES)
    counted = found.groupBy("root_id").agg(
        F.count_if(callable_ & (F.col("relation") == "caller")).alias("n_callers"), F.count_if(callable_ & (F.col("relation") == "callee")).alias("n_callees"), F.count_if((F.col("node_type") == "test") & (F.col("relation") == "caller")).alias("n_upstream")
    )
    tests = nodes.where("type = 'test'").select(F.col("id").alias("source"))
    linked = edges.where("type = 'tested_by'").join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("root_id"), F.col("target").alias("test"))
    calling = edges.where("type = 'calls'").join(tests, "source", "left_semi").select(F.col("target").alias("root_id"), F.col("source").alias("test"))
    n_tests = linked.unionByName(calling).groupBy("root_id").agg(F.count_distinct("test").alias("n_tests"))
    j = (
        starts.join(nodes.select(F.col("id").alias("root_id"), "type", "name", "file_path", "tags"), "root_id", "left")
        .join(counted, "root_id", "left")
        .join(n_tests, "root_id", "left")
        .fillna(0, ["n_callers", "n_callees", "n_upstream", "n_tests"])
    )
    path = F.col("file_path")
    route = (F.col("type") == "route") | F.coalesce(F.array_contains("tags", "route"), F.lit(False))
    sensitive = dims.has_word(path, dims.SENSITIVE_WORDS) | (route & dims.has_word(F.col("name"), dims.SENSITIVE_WORDS))
    api = F.coalesce(F.contains(F.lower(path), F.lit("/api/")), F.lit(False)) | F.coalesce(route, F.lit(False))
    tested = F.col("n_tests") + F.col("n_upstream") > 0
    level = (
        F.when(F.col("type").isNull(), "unknown")
        .when(sensitive & ~tested & (F.col("n_callers") >= 3) & dims.has_word(path, dims.MUTATION_WORDS), "critical")
        .when(sensitive | api, "high")
        .when(F.col("n_callers") >= 5, "high")
        .when(F.col("n_callers") + F.col("n_callees") > 0, "medium")
        .otherwise("low")
    )
    return j.select("root_id", level.alias("risk"), "n_callers", "n_callees", "n_tests")


def external_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per symbol the other ends of its calls that are no node, an external symbol, or reached by a resolution that blocks traversal: once each, the first edge."""
    calls = edges.where("type = 'calls'")
    ends = calls.select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), F.lit(0).alias("way")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"), F.lit(1).alias("way")))), "edge_id", "confidence", "resolution")
    j = ends.join(nodes.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type")), "other", "left")
    out = j.where(F.col("other_type").isNull() | (F.col("other_type") == "external_symbol") | dims.blocks_traversal(F.col("resolution")))
    one = out.groupBy("id", "other").agg(F.min(F.struct("way", "edge_id", "confidence", "resolution")).alias("e"))
    return one.select("id", "other", F.when(F.col("e.way") == 0, "target").otherwise("source").alias("role"), "e.confidence", F.coalesce("e.resolution", F.lit("unknown")).alias("resolution"), dims.tier(F.col("e.resolution")).alias("category"))


def impact_files(found: DataFrame) -> DataFrame:
    """Files with confirmed impact per start."""
    return found.where("confirmed and file_path is not null").groupBy("root_id", "file_path").agg(F.min("distance").alias("distance"), F.count_distinct("id").alias("n_symbols"))


def pre_edit(risks: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per file that might be edited: what all of its symbols reach together, and the greatest risk."""
    of = nodes.where("file_path is not null").select(F.col("id").alias("root_id"), F.col("file_path").alias("edited"))
    reached = found.where("confirmed").join(of, "root_id").groupBy("edited").agg(F.count_distinct("id").alias("n_symbols"), F.count_distinct("file_path").alias("n_files"))
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    worst = risks.join(of, "root_id").groupBy("edited").agg(F.max(rank).alias("r"))
    return worst.join(reached, "edited", "left").fillna(0, ["n_symbols", "n_files"]).select(F.col("edited").alias("file_path"), F.element_at(F.array(*map(F.lit, RISKS)), F.col("r").cast("int")).alias("risk"), "n_symbols", "n_files")


def related_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tests of each symbol: by tested_by edges, else calls from test code (the better confidence counts)."""
    linked = edges.where("type = 'tested_by'").select(F.col("source").alias("id"), F.col("target").alias("test_id"), "confidence", F.lit(0).alias("way"))
    test_code = nodes.where((F.col("type") == "test") | dims.is_coverage_test_path(F.col("file_path"))).select(F.col("id").alias("source"))
    calling = edges.where("type = 'calls'").join(test_code, "source", "left_semi").select(F.col("target").alias("id"), F.col("source").alias("test_id"), "confidence", F.lit(1).alias("way"))
    both = linked.unionByName(calling).groupBy("id", "test_id").agg(F.min(F.struct("way", (-F.col("confidence")).alias("c"))).alias("b"))
    return both.select("id", "test_id", F.when(F.col("b.way") == 0, "tested_by").otherwise("calls").alias("via"), (-F.col("b.c")).alias("confidence"))


#: What each relation to the entry adds, and how much each importance weighs.
RELATION_IMPACT = {"entry_point": 1.0, "callee": 0.8, "model": 0.7, "config": 0.7, "caller": 0.6, "store": 0.6, "test": 0.4}
IMPORTANCE = {"critical": 1.0, "high": 0.85, "medium": 0.6, "low": 0.3}


def item_score(task: str, relation: Column, importance: Column, confidence: Column, distance: Column) -> Column:
    """Score of a node as an item of a context: .35 relevance, .2 importance, .15 confidence, .15 relation, .05 for a test, less .05 for distance and .05 for length; 0 to 1."""
    pick = lambda table, c, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(other))
    effect = pick(RELATION_IMPACT, relation, 0.5)
    effect = F.when(F.array_contains("tags", "route"), F.least(effect + 0.1, F.lit(1.0))).otherwise(effect)
    relevance, _ = search.relevance_parts(task)
    raw = (
        relevance * 0.35 + pick(IMPORTANCE, importance, 0.5) * 0.20 + confidence * 0.15 + effect * 0.15 + F.when(F.col("type") == "test", 0.05).otherwise(0.0)
        - F.least(distance / 5.0, F.lit(1.0)) * 0.05 - F.least(F.coalesce(F.length("code_preview"), F.lit(0)) / 2000.0, F.lit(1.0)) * 0.05
    )
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) + 1e-9, 4)


def context_items(nodes: DataFrame, edges: DataFrame, entries: DataFrame, task: str) -> DataFrame:
    """What surrounds the entries of a task, once each, with its relation, tier and score.

    `entries` has id. Callees, callers and tests one step away, and the models, configurations and
    stores among the ends of any edge that begins at an entry. The nearest and surest relation
    counts. Tiers, in order: sure callees (.75), tests, models and the like, other, low confidence.
    """
    e = edges.join(entries.select(F.col("id").alias("entry")), (F.col("source") == F.col("entry")) | (F.col("target") == F.col("entry")))
    out = F.col("source") == F.col("entry")
    other = F.when(out, F.col("target")).otherwise(F.col("source"))
    near = e.select(other.alias("id"), "type", out.alias("out"), "confidence").join(entries.select("id"), "id", "left_anti").withColumnRenamed("type", "edge")
    n = near.join(nodes, "id")
    tag = lambda t: F.array_contains("tags", t)
    kind = F.when(tag("model"), "model").when(tag("config"), "config").when(tag("store") | tag("persistence"), "store")
    relation = F.when((F.col("edge") == "tested_by") | (F.col("type") == "test"), "test").when((F.col("type") == "class") & kind.isNotNull(), kind).when((F.col("edge") == "calls") & F.col("out"), "callee").when(F.col("edge") == "calls", "caller")
    n = n.withColumn("relation", relation).where("relation is not null")
    importance = F.when((F.col("relation") == "callee") & (F.col("confidence") >= 0.75), "high").when(F.col("relation").isin("callee", "test"), "medium").otherwise("low")
    n = n.withColumn("importance", importance).withColumn("score", item_score(task, F.col("relation"), importance, F.col("confidence"), F.lit(1)))
    tier = F.when(F.col("confidence") < dims.MEDIUM, 5).when((F.col("relation") == "callee") & (F.col("importance") == "high"), 1).when(F.col("relation") == "test", 2).when(F.col("relation").isin("model", "config", "store"), 3).otherwise(4)
    w = Window.partitionBy("id").orderBy("tier", F.desc("score"), "relation")
    return n.withColumn("tier", tier).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "relation", "importance", "confidence", "tier", "score")


def context_scores(nodes: DataFrame, edges: DataFrame, task: str) -> DataFrame:
    """Every symbol as if it were a callee one step away, of the mean confidence of its edges."""
    deg = edges.select(F.explode(F.array("source", "target")).alias("id"), "confidence").groupBy("id").agg(F.count("*").alias("degree"), F.avg("confidence").alias("mean_confidence"))
    n = nodes.where(~F.col("type").isin("file", "module", "external_symbol")).join(deg, "id", "left")
    importance = F.when(F.col("degree") >= 50, "critical").when(F.col("degree") >= 10, "high").when(F.col("degree") >= 3, "medium").otherwise("low")
    return n.select("id", item_score(task, F.lit("callee"), importance, F.round(F.coalesce("mean_confidence", F.lit(0.0)), 6), F.lit(1)).alias("score"))
