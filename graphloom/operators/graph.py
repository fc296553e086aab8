"""The graph as two DataFrames, and the operators that need one look at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.functions.keys import clean_id, clean_path, edge_type, node_type


def current_nodes(nodes: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """The last row of each id, if it is still there, in canonical spelling, with external symbols.

    Rows without id are no nodes. Reversed line ranges are put in order, null tags are none.
    """
    seen = nodes.select(
        clean_id(F.col("id")).alias("id"), node_type(F.col("type")).alias("type"), "name", clean_path(F.col("file_path")).alias("file_path"), "module", "qualified_name", F.lower("language_id").alias("language_id"),
        F.least("location.line_start", "location.line_end").alias("line_start"), F.greatest("location.line_start", "location.line_end").alias("line_end"),
        "signature", "docstring", "code_preview", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "repo_id", "indexed_at", "removed_at",
    ).where("id is not null")
    order = [F.col("indexed_at").desc_nulls_last(), F.col("removed_at").desc_nulls_first()] + [F.col(c).asc_nulls_last() for c in ("type", "file_path", "language_id", "docstring", "signature", "code_preview", "name", "qualified_name", "module", "line_start", "line_end")] + [F.array_join("tags", ",")]
    last = seen.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("rn = 1 and removed_at is null").drop("rn", "removed_at", "indexed_at")
    if external is None:
        return last
    none = [F.lit(None).cast(t).alias(c) for c, t in (("signature", "string"), ("docstring", "string"), ("code_preview", "string"))]
    ext = (
        external.select(clean_id(F.col("id")).alias("id"), "name", "qualified_name", "indexed_at", "removed_at")
        .where("id is not null")
        .withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("indexed_at").desc_nulls_last(), F.col("removed_at").desc_nulls_first())))
        .where("rn = 1 and removed_at is null")
        .select(
            "id", F.lit("external_symbol").alias("type"), "name", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("module"), "qualified_name", F.lit(None).cast("string").alias("language_id"),
            F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), *none, F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("repo_id"),
        )
    )
    return last.unionByName(ext)


def current_edges(edges: DataFrame) -> DataFrame:
    """One edge per source, target and type: the first by id wins; redelivered rows count once.

    Edges with an end that names nothing are left out (validation reports them). Confidence is
    clamped to [0, 1]; a missing one is that of the resolution.
    """
    resolution = F.col("metadata.resolution")
    conf = F.least(F.greatest(F.coalesce("confidence", dims.default_confidence(resolution)), F.lit(0.0)), F.lit(1.0))
    flat = edges.select(
        F.col("id").alias("edge_id"), clean_id(F.col("source")).alias("source"), clean_id(F.col("target")).alias("target"), edge_type(F.col("type")).alias("type"), conf.alias("confidence"), resolution.alias("resolution"), F.col("metadata.call_expr").alias("call_expr")
    ).where("source is not null and target is not null")
    return flat.groupBy("source", "target", "type").agg(F.min(F.struct("edge_id", "confidence", "resolution", "call_expr")).alias("e")).select("source", "target", "type", "e.*")


def by_pattern(df: DataFrame, equals: dict[str, str], contains: dict[str, str], order: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows whose columns equal or contain (literally, in any ASCII case) given texts, one page in order."""
    for c, v in equals.items():
        df = df.where(F.col(c) == v)
    for c, v in contains.items():
        df = df.where(F.contains(F.lower(c), F.lit(v.lower())))
    df = df.orderBy(order) if limit is not None else df
    return df.offset(offset).limit(limit) if limit is not None else df


def direct(edges: DataFrame, nodes: DataFrame, end: str, types: tuple[str, ...] = ("calls",)) -> DataFrame:
    """Number of distinct direct callers (end="target") or callees (end="source") per symbol, and their mean confidence."""
    other = "source" if end == "target" else "target"
    e = edges.where(F.col("type").isin(*types)).select(F.col(end).alias("id"), F.col(other).alias("other"), "confidence")
    return e.groupBy("id").agg(F.count_distinct("other").alias("n_neighbors"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).join(nodes.select("id", "name", F.col("type").alias("node_type")), "id")


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions, one edge per neighbour: outgoing first, then by edge id."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbor"), F.lit(0).alias("way"), "edge_id", "type", "confidence")
    back = edges.select(F.col("target").alias("id"), F.col("source").alias("neighbor"), F.lit(1).alias("way"), "edge_id", "type", "confidence")
    one = out.unionByName(back).groupBy("id", "neighbor").agg(F.min(F.struct("way", "edge_id", "type", "confidence")).alias("e"))
    return one.select("id", "neighbor", F.when(F.col("e.way") == 0, "outgoing").otherwise("incoming").alias("direction"), "e.type", "e.confidence")


def neighbour_role(edge: Column, direction: Column, neighbour_type: Column, path: Column) -> Column:
    """What a neighbour is to the centre."""
    return (
        F.when(neighbour_type.isNull() | (neighbour_type == "external_symbol"), "external")
        .when((neighbour_type == "test") | dims.is_test_path(path) | (edge == "tested_by"), "test")
        .when((edge == "calls") & (direction == "incoming"), "caller")
        .when((edge == "calls") & (direction == "outgoing"), "callee")
        .when(edge.isin("contains", "defined_in"), "structure")
        .when(edge == "imports", "import")
        .otherwise("related")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes by type, files, edges and edges of low confidence."""
    kinds = ("file", "module", "class", "function", "method", "external_symbol")
    n = nodes.agg(F.count("*").alias("n_nodes"), *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds], F.count_distinct("file_path").alias("n_files"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("confidence") < dims.MEDIUM).alias("n_low_confidence"))
    return n.join(F.broadcast(e), F.lit(True)).withColumn("low_confidence_ratio", F.round(F.col("n_low_confidence") / F.greatest("n_edges", F.lit(1)), 4))  # one row each


def file_overview(nodes: DataFrame) -> DataFrame:
    count = lambda cond, name: F.count_if(cond).alias(name)
    t = F.col("type")
    return nodes.where("file_path is not null").groupBy("file_path").agg(count(~t.isin("file", "module"), "n_symbols"), count(t.isin("function", "method"), "n_functions"), count(t == "class", "n_classes"), count(t == "test", "n_tests"), F.max("language_id").alias("language"))


def cross_file_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different files, by pair of files."""
    f = nodes.where("file_path is not null").select("id", "file_path")
    s = f.select(F.col("id").alias("source"), F.col("file_path").alias("source_file"))
    t = f.select(F.col("id").alias("target"), F.col("file_path").alias("target_file"))
    return edges.select("source", "target").join(s, "source").join(t, "target").where("source_file <> target_file").groupBy("source_file", "target_file").agg(F.count("*").alias("n_edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each id, counted map-side so that hubs do not travel."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def entry_points(nodes: DataFrame, edges: DataFrame, k: int = 6) -> DataFrame:
    """The k symbols of highest degree that are no tests, files, packages, externals or initialisers."""
    t = F.col("type")
    priority = F.when(t == "route", 5).when(t == "controller", 4).when(t == "service", 3).when(t == "class", 2).when(t == "function", 1).otherwise(0)
    keep = ~t.isin("test", "file", "module", "external_symbol") & ~dims.is_test_path(F.col("file_path")) & ~F.coalesce(F.col("name").isin("__init__", "constructor"), F.lit(False))
    ranked = nodes.where(keep).join(degrees(edges), "id").withColumn("priority", priority)
    return ranked.orderBy(F.desc("degree"), F.desc("priority"), F.length("file_path"), "id").limit(k).select("id", "name", "type", "degree")


def relation_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers, callees and tests of each symbol, and files that its callers lie in."""
    calls = edges.where("type = 'calls'")
    by_target = calls.join(nodes.select(F.col("id").alias("source"), F.col("file_path").alias("caller_file")), "source", "left").groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("n_callers"), F.count_distinct("caller_file").alias("n_impact_files"))
    by_source = calls.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("n_callees"))
    tests = edges.where("type = 'tested_by'").groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("n_tests"))
    symbols = nodes.where(~F.col("type").isin("file", "module", "external_symbol")).select("id", "type")
    return symbols.join(by_target, "id", "left").join(by_source, "id", "left").join(tests, "id", "left").fillna(0, ["n_callers", "n_impact_files", "n_callees", "n_tests"])


def class_members(nodes: DataFrame) -> DataFrame:
    """Methods per class. The class is cut out of the id, so the prefix match is an equi-join."""
    m = nodes.where("type = 'method'").select("id", F.regexp_extract("id", r"^(.*)\.[^.:/]+$", 1).alias("class_id"), "line_start")
    c = nodes.where("type = 'class'").select(F.col("id").alias("class_id"), "name")
    return c.join(m, "class_id", "left").groupBy("class_id", "name").agg(F.count("id").alias("n_methods"), F.min("line_start").alias("first_line"))


def repo_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository: kinds of nodes, languages, and quality of the edges that begin there."""
    t = F.col("type")
    per_repo = nodes.where("repo_id is not null").groupBy("repo_id").agg(
        F.count_distinct("file_path").alias("n_files"), F.count_if(~t.isin("file", "module")).alias("n_symbols"), F.count_if(t.isin("function", "method")).alias("n_functions"), F.count_if(t == "class").alias("n_classes"),
        F.count_distinct("language_id").alias("n_languages"), F.count_if(dims.is_test_path(F.col("file_path"))).alias("n_test_nodes"),
    )
    quality = edges.join(nodes.select(F.col("id").alias("source"), "repo_id"), "source").groupBy("repo_id").agg(F.count("*").alias("n_edges"), F.round(F.avg(F.when(F.col("confidence") < dims.MEDIUM, 1.0).otherwise(0.0)), 4).alias("low_confidence_ratio"))
    return per_repo.join(quality, "repo_id", "left").fillna(0, ["n_edges"])


def edge_quality_by_language(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    src = nodes.select(F.col("id").alias("source"), F.coalesce("language_id", F.lit("unknown")).alias("language"))
    return edges.join(src, "source").groupBy("language").agg(F.count("*").alias("n_edges"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") < dims.MEDIUM).alias("n_low"))


def resolve_external_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls to `external:<qualified name>` whose symbol is in the graph, with the node they mean.

    Of several nodes with a name a callable beats a module or file, that beats an import; then the
    smallest id. Weak resolutions are never rewritten.
    """
    t = F.col("type")
    priority = F.when(t.isin("function", "method", "class", "test"), 3).when(t.isin("module", "file"), 1).when(t == "import", 0).otherwise(-1)
    w = Window.partitionBy("qualified_name").orderBy(F.desc("priority"), "id")
    lookup = nodes.where(F.col("qualified_name").isNotNull() & (t != "external_symbol")).withColumn("priority", priority).where("priority >= 0").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("qualified_name", F.col("id").alias("resolved"))
    weak = ("name_match_candidate", "callback_candidate", "unknown_receiver_method", "dynamic_dispatch", "unknown_symbol", "unresolved")
    ext = edges.where((F.col("type") == "calls") & F.col("target").startswith("external:") & ~F.coalesce(F.col("resolution").isin(*weak), F.lit(False)))
    return ext.withColumn("qualified_name", F.substring("target", 10, 1 << 20)).join(lookup, "qualified_name").select("source", "target", "resolved")


def names_tests(nodes: DataFrame) -> DataFrame:
    """Test edges by name: a function `test_<name>…` tests the callable whose name is its longest `_`-prefix."""
    tests = nodes.where(F.col("type").isin("function", "method", "test") & F.col("name").startswith("test_")).select(F.col("id").alias("test_id"), "repo_id", F.split(F.substring("name", 6, 1 << 20), "_").alias("parts"))
    prefixes = tests.select("test_id", "repo_id", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k"), "parts").select("test_id", "repo_id", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "_").alias("name"))
    callables = nodes.where(F.col("type").isin("function", "method", "class") & ~F.col("name").startswith("test_")).select("id", "repo_id", "name")
    w = Window.partitionBy("test_id").orderBy(F.desc("k"), "id")
    return prefixes.join(callables, ["repo_id", "name"]).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("id").alias("source"), F.col("test_id").alias("target"), F.lit(0.65).alias("confidence"))


def star_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Models, configurations and stores that a file depends on, through what it imports."""
    tagged = nodes.where("type = 'class' and size(tags) > 0").select(
        F.col("id").alias("target"), "name", F.when(F.array_contains("tags", "model"), "model").when(F.array_contains("tags", "config"), "config").when(F.array_contains("tags", "store") | F.array_contains("tags", "persistence"), "store").alias("kind")
    )
    files = nodes.where("file_path is not null").select(F.col("id").alias("source"), "file_path")
    uses = edges.where(F.col("type").isin("imports", "references", "depends_on", "inherits", "calls")).select("source", "target")
    return uses.join(tagged.where("kind is not null"), "target").join(files, "source").groupBy("file_path", "kind").agg(F.count_distinct("target").alias("n_dependencies"))
