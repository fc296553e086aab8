"""Queries of the graph catalogue over the index tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.functions.keys import BLANKS, EDGE_TYPES, NODE_ALIASES, NODE_TYPES, clean_id, edge_type, node_type, strip
from graphloom.operators import coverage, enrichment, graph, impact, incremental, search, traversal, validation
from graphloom.plans.general import _sql_id, _sql_type
from graphloom.runtime import table

SEARCHES = ["resolve_bucket", "LazySignalStore flush", "marker rewrites", "record"]
TASK = "fix the cache refresh of the ledger store when a record is missing"
MISSPELLED = ["PendngBrnchStor", "fetchCahce"]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.current_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "external_nodes"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.current_edges(table(spark, sf_dir, "edges"))


def _ne(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(nodes(spark, d), edges(spark, d))


def _n(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(nodes(spark, d))


def _e(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(edges(spark, d))


def _raw(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(table(spark, d, name))


# SQL building blocks

_L = "lower(language_id)"
_SQL_NODE_TYPE = lambda c: f"case lower(trim({c}, '{BLANKS}')) " + " ".join(f"when '{a}' then '{b}'" for a, b in NODE_ALIASES.items()) + f" else lower(trim({c}, '{BLANKS}')) end"
_SQL_PATH = lambda c: f"nullif(regexp_replace({_sql_id(c)}, '^([.]/)+', ''), '')"
_RES = " union all ".join(f"select '{n}' resolution, '{t}' tier, {c}::double default_confidence, {str(b).lower()} blocks" for n, t, c, b in dims.resolution_rows())


def _quote(s: str) -> str:
    return s.replace("'", "''")


def _matches(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, '{_quote(pattern)}'), false)"


_TEST = lambda c="file_path": _matches(f"lower({c})", dims.TEST_PATH)
_COVTEST = lambda c="file_path": f"({_matches(f'lower({c})', dims.TEST_FOLDER)} or {_matches(c, dims.TEST_FILE)})"
_PROD = lambda c="file_path": _matches(f"lower({c})", "/(" + "|".join(dims.PRODUCTION_ROOTS) + ")/")
_WORDS = lambda c, words: _matches(f"lower({c})", "|".join(words))

NODES_SQL = f"""
raw_nodes as (
  select {_sql_id("id")} id, {_SQL_NODE_TYPE("type")} as type, name, {_SQL_PATH("file_path")} file_path, module, qualified_name, {_L} language_id,
    least(location.line_start, location.line_end) line_start, greatest(location.line_start, location.line_end) line_end, signature, docstring, code_preview, coalesce(tags, []) tags, repo_id, indexed_at, removed_at from nodes),
n as (
  select * exclude (indexed_at, removed_at, rn) from (select *, row_number() over (partition by id order by indexed_at desc nulls last, removed_at desc nulls first, type nulls last, file_path nulls last, language_id nulls last, docstring nulls last, signature nulls last, code_preview nulls last, name nulls last, qualified_name nulls last, module nulls last, line_start nulls last, line_end nulls last, array_to_string(tags, ',')) rn
    from raw_nodes where id is not null) where rn = 1 and removed_at is null
  union all
  select id, 'external_symbol', name, null, null, qualified_name, null, null, null, null, null, null, [], null from (
    select {_sql_id("id")} id, name, qualified_name, removed_at, row_number() over (partition by {_sql_id("id")} order by indexed_at desc nulls last, removed_at desc nulls first) rn from external_nodes) where rn = 1 and removed_at is null and id is not null)"""
EDGES_SQL = f"""
res as ({_RES}),
e as (
  select * exclude (rn) from (
    select *, row_number() over (partition by source, target, type order by edge_id, confidence, resolution nulls first, call_expr nulls first) rn from (
      select id edge_id, {_sql_id("source")} source, {_sql_id("target")} target, {_sql_type("type")} as type,
        least(greatest(coalesce(confidence, default_confidence, {dims.UNKNOWN_CONFIDENCE}), 0.0), 1.0)::double confidence, metadata.resolution resolution, metadata.call_expr call_expr
      from edges left join res on res.resolution = metadata.resolution) where source is not null and target is not null) where rn = 1)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return "with " + "recursive " * recursive + ",".join(parts) + "\n"


N, E = _with(NODES_SQL), _with(EDGES_SQL)
NE = _with(NODES_SQL, EDGES_SQL)
_ALLOWED = "type in ('calls', 'routes_to', 'depends_on') and not coalesce((select blocks from res where res.resolution = e.resolution), false)"


def _reach_sql(starts: str, direction: str, depth: int, name: str = "reach", links: str | None = None) -> str:
    """Levels written out one after the other, each without what earlier ones have."""
    a, b = ("target", "source") if direction == "incoming" else ("source", "target")
    parts = [f"{name}_l as ({links or f'select {a} at_, {b} to_, max(confidence) confidence from e where {_ALLOWED} group by all'})", f"{name}_0 as (select distinct root_id, root_id id from ({starts}))"]
    for d in range(1, depth + 1):
        seen = " ".join(f"and not exists (from {name}_{k} v where v.root_id = f.root_id and v.id = l.to_)" for k in range(d))
        parts.append(f"{name}_{d} as (select f.root_id, l.to_ id, {d} distance, max(l.confidence) confidence from {name}_{d - 1} f join {name}_l l on l.at_ = f.id where true {seen} group by f.root_id, l.to_)")
    parts.append(f"{name} as (" + " union all ".join(f"select root_id, id, distance, confidence from {name}_{d}" for d in range(1, depth + 1)) + ")")
    return ",".join(parts)


_ALL_STARTS = "select id root_id from n"
_FN_STARTS = "select id root_id from n where type in ('function', 'method', 'class')"


def _starts(n: DataFrame, *types: str) -> DataFrame:
    return n.where(F.col("type").isin(*types)).select(F.col("id").alias("root_id"))


def transitive_callers_d2(spark: SparkSession, d: str) -> DataFrame:
    return traversal.reach(nodes(spark, d).select(F.col("id").alias("root_id")), traversal.steps(edges(spark, d), "incoming"), 2).withColumn("confidence", F.round("confidence", 6))


def transitive_callees_d2(spark: SparkSession, d: str) -> DataFrame:
    return traversal.reach(_starts(nodes(spark, d), "function", "method", "class"), traversal.steps(edges(spark, d), "outgoing"), 2).withColumn("confidence", F.round("confidence", 6))


def callees_with_missing(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return traversal.callers_with_missing(_starts(n, "function", "method"), edges(spark, d), n).groupBy("root_id", "known").agg(F.count("*").alias("n"))


def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    return traversal.subgraph(nodes(spark, d).select(F.col("id").alias("root_id")), edges(spark, d), 1)


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n, e = nodes(spark, d), edges(spark, d)
    starts = _starts(n, "function", "method", "class")
    return n, e, starts, impact.impact_pairs(starts, n, e)


def impact_confirmed(spark: SparkSession, d: str) -> DataFrame:
    n, e, starts, pairs = _pairs(spark, d)
    return impact.confirmed_counts(pairs, starts)


def impact_files(spark: SparkSession, d: str) -> DataFrame:
    n, e, starts, pairs = _pairs(spark, d)
    return impact.impact_files(impact.reached_nodes(pairs, starts, n))


def impact_risk(spark: SparkSession, d: str) -> DataFrame:
    n, e, starts, pairs = _pairs(spark, d)
    return impact.risk(starts, n, e, impact.reached_nodes(pairs, starts, n))


def pre_edit_batch(spark: SparkSession, d: str) -> DataFrame:
    n, e, starts, pairs = _pairs(spark, d)
    found = impact.reached_nodes(pairs, starts, n)
    return impact.pre_edit(impact.risk(starts, n, e, found), found, n)


def validate(spark: SparkSession, d: str) -> DataFrame:
    return validation.edge_issues(*[table(spark, d, t) for t in ("edges", "nodes", "external_nodes")]).unionByName(validation.node_issues(table(spark, d, "nodes")))


def change_classify(spark: SparkSession, d: str) -> DataFrame:
    return incremental.classify(*incremental.last_two(table(spark, d, "fingerprints")))


def dependents(spark: SparkSession, d: str) -> DataFrame:
    return incremental.dependents(change_classify(spark, d), nodes(spark, d), edges(spark, d))


def incremental_remove(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each repository's graph without the files that went or changed in structure."""
    files = change_classify(spark, d).where(F.col("change").isin("STRUCTURAL", "DELETED")).select("file_path")
    n, e = incremental.remove_files(nodes(spark, d), edges(spark, d), files)
    left = e.join(n.select(F.col("id").alias("source"), "repo_id"), "source").groupBy("repo_id").agg(F.count("*").alias("n_edges"))
    return n.where("repo_id is not null").groupBy("repo_id").agg(F.count("*").alias("n_nodes")).join(left, "repo_id", "left").fillna(0, ["n_edges"])


def enrichment_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every documented symbol's first line as its summary, and its kind as a tag."""
    n = nodes(spark, d)
    a = n.where("length(trim(docstring)) > 0").select("id", F.regexp_extract("docstring", r"([^\n\r]*)", 1).alias("summary"), F.array(F.upper("type")).alias("tags"))
    return enrichment.merge_annotations(n, a).select("id", "summary", F.array_join("tags", ",").alias("tags"))


def enrichment_issues(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source = 'api_summary'")
    a = enrichment.parse_annotations(docs).select(F.col("symbol").alias("id"), "summary")
    return enrichment.annotation_issues(a, nodes(spark, d))


def neighbors_by_role(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select(F.col("id").alias("neighbor"), F.col("type").alias("neighbor_type"), "file_path")
    j = graph.neighbours(edges(spark, d)).join(n, "neighbor", "left")
    return j.groupBy(graph.neighbour_role(F.col("type"), F.col("direction"), F.col("neighbor_type"), F.col("file_path")).alias("role"), "direction").agg(F.count("*").alias("n"))


def path_flags(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return nodes(spark, d).where("type = 'file' and file_path is not null").select("file_path", dims.layer(p).alias("layer"), dims.language(p).alias("language"), dims.is_test_path(p).alias("test"), dims.is_coverage_test_path(p).alias("coverage_test"), dims.is_production_path(p).alias("production"), dims.is_excluded(p).alias("excluded"), dims.has_word(p, dims.SENSITIVE_WORDS).alias("sensitive"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(search.terms(nodes(spark, d)), SEARCHES)


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of each function's body in its file, at most five."""
    f = table(spark, d, "source_files").groupBy("file_path").agg(F.max(F.struct("loaded_at", "content")).alias("f")).select("file_path", F.split(F.decode("f.content", "UTF-8"), r"\r\n|\r|\n").alias("lines"))
    fn = nodes(spark, d).where("type in ('function', 'method') and line_start > 0").select("id", "file_path", "line_start", "line_end")
    size = F.least(F.col("line_end") - F.col("line_start") + 1, F.lit(5))
    return fn.join(f, "file_path").where(F.size("lines") >= F.col("line_start")).select("id", F.array_join(F.slice("lines", F.col("line_start"), size), "\n").alias("snippet"))


def external_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every call to a symbol written as an extractor writes it before resolution, by its qualified name, and resolved back."""
    n, e = nodes(spark, d), edges(spark, d)
    raw = e.where("type = 'calls'").join(n.where("qualified_name is not null").select(F.col("id").alias("target"), "qualified_name"), "target")
    return graph.resolve_external_calls(n, e.unionByName(raw.withColumn("target", F.concat(F.lit("external:"), "qualified_name")).select(*e.columns))).distinct()


def test_edge_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """A test made up for every callable, named after it, finds the callable of the longest name."""
    n = nodes(spark, d)
    tests = n.where(F.col("type").isin("function", "method", "class")).withColumn("id", F.concat(F.lit("test of "), "id")).withColumn("type", F.lit("test")).withColumn("name", F.concat(F.lit("test_"), "name", F.lit("_twice")))
    return graph.names_tests(n.unionByName(tests))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "graph_stats": _ne(graph.graph_stats),
    "type_counts": _n(lambda n: n.groupBy("type").agg(F.count("*").alias("n"))),
    "edge_type_counts": _e(lambda e: e.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))),
    "node_filter": _n(lambda n: graph.by_pattern(n, {"type": "class"}, {"file_path": "src", "name": "store"}, "id", 200).select("id", "name", "file_path")),
    "edge_filter": _e(lambda e: graph.by_pattern(e, {"type": "calls"}, {"target": "external:"}, "edge_id", 500, 10).select("edge_id", "source", "target")),
    "node_lookup": _n(lambda n: n.where("id = 'external:indexlib.checkGauge'").select("id", "type", "name", "qualified_name")),
    "edges_between": _e(lambda e: e.groupBy("source", "target").agg(F.count("*").alias("n_types"), F.max("confidence").alias("best")).where("n_types > 1")),
    "callers_direct": _ne(lambda n, e: graph.direct(e, n, "target")),
    "callees_direct": _ne(lambda n, e: graph.direct(e, n, "source")),
    "neighbors_by_role": neighbors_by_role,
    "confidence_levels": _e(lambda e: e.groupBy(dims.confidence_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))),
    "resolution_tiers": _e(lambda e: e.where("resolution is not null").groupBy("resolution").agg(F.count("*").alias("n")).withColumn("tier", dims.tier(F.col("resolution"))).withColumn("blocks", dims.blocks_traversal(F.col("resolution")))),
    "transitive_callers_d2": transitive_callers_d2,
    "transitive_callees_d2": transitive_callees_d2,
    "callees_with_missing": callees_with_missing,
    "subgraph_edges": subgraph_edges,
    "file_overview": _n(graph.file_overview),
    "cross_file_edges": _ne(graph.cross_file_edges),
    "entry_points_topk": _ne(graph.entry_points),
    "relation_counts": _ne(graph.relation_counts),
    "class_members": _n(graph.class_members),
    "repo_summary_current": _ne(graph.repo_summary),
    "low_conf_ratio_by_language": _ne(graph.edge_quality_by_language),
    "external_resolve": external_resolve,
    "test_edge_prefix_match": test_edge_prefix_match,
    "star_dependencies": _ne(graph.star_dependencies),
    "related_tests": _ne(lambda n, e: impact.related_tests(n, e).withColumn("confidence", F.round("confidence", 6))),
    "edge_dedup_first_wins": _e(lambda e: e.select("edge_id", "source", "target", "type")),
    "edge_type_normalize": _raw("edges", lambda e: e.groupBy(F.col("type").alias("raw"), edge_type(F.col("type")).alias("canonical")).agg(F.count("*").alias("n"))),
    "node_type_normalize": _raw("nodes", lambda n: n.groupBy(F.col("type").alias("raw"), node_type(F.col("type")).alias("canonical")).agg(F.count("*").alias("n"))),
    "validation_issues": validate,
    "breakdown_by_reason": lambda s, d: validation.breakdown(validate(s, d)),
    "validation_health": lambda s, d: validation.health(validate(s, d), table(s, d, "edges")),
    "dangling_edges": lambda s, d: validate(s, d).where(F.col("reason").isin("missing_source", "missing_target", "missing_both")).select("id", "reason"),
    "orphan_ratio": _ne(validation.isolated_ratio),
    "coverage_buckets": _ne(lambda n, e: coverage.coverage_buckets(n, e).select("id", "bucket", "n_tests")),
    "coverage_by_file": _ne(lambda n, e: coverage.coverage_by_file(coverage.coverage_buckets(n, e))),
    "coverage_summary": _ne(lambda n, e: coverage.coverage_summary(coverage.coverage_buckets(n, e))),
    "coverage_signal": _ne(coverage.coverage_signal),
    "search_inmemory": _n(lambda n: search.plain_scores(n, SEARCHES).select("query", "id", "score")),
    "search_multipass": _n(lambda n: search.multi_pass(n, SEARCHES)),
    "search_paged": _n(lambda n: search.multi_pass(n, SEARCHES, limit=7, offset=5)),
    "search_filtered": _n(lambda n: search.multi_pass(n, SEARCHES, keep=search.search_filter(types=["function", "method", "class"], exclude_paths=["*/test*"], languages=["python", "go"], tests=False, external=False))),
    "search_fuzzy": _n(lambda n: search.multi_pass(n, MISSPELLED)),
    "external_calls": _ne(impact.external_calls),
    "bm25_topk": bm25_topk,
    "fts_terms": _n(lambda n: search.terms(n).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))),
    "name_decompose": _n(lambda n: n.where("name is not null").select("name").distinct().select("name", F.array_join(F.array_sort(search.decompose(F.col("name"))), " ").alias("parts"))),
    "tokenize": _raw("documents", lambda t: t.where("text is not null").select("doc_id", F.size(search.tokenize(F.col("text"))).alias("n_words"), search.token_estimate(F.col("text")).cast("long").alias("n_tokens"))),
    "relevance_score": _n(lambda n: search.relevance(n, TASK)),
    "context_item_score": _ne(lambda n, e: impact.context_scores(n, e, TASK)),
    "impact_confirmed": impact_confirmed,
    "impact_files": impact_files,
    "impact_risk": impact_risk,
    "pre_edit_batch": pre_edit_batch,
    "change_classify": change_classify,
    "incremental_plan": lambda s, d: incremental.plan(change_classify(s, d)),
    "dependents": dependents,
    "incremental_remove": incremental_remove,
    "enrichment_status": _n(enrichment.enrichment_status),
    "enrichment_merge": enrichment_merge,
    "enrichment_issues": enrichment_issues,
    "path_flags": path_flags,
    "snippets": snippets,
}

_HAS = lambda c: f"coalesce(contains(lower({c}), q), false)"
_Q = "(select unnest([" + ", ".join(f"'{q}'" for q in SEARCHES) + "]) query)"
_PLAIN = f"""greatest(case when coalesce(lower(id) = q or lower(name) = q, false) then 1.0 else 0 end, case when {_HAS("qualified_name")} then 0.9 else 0 end, case when {_HAS("name")} then 0.8 else 0 end,
  case when {_HAS("file_path")} then 0.7 else 0 end, case when {_HAS("docstring")} then 0.5 else 0 end)::double"""
_SAME = lambda c: f"coalesce({c} = query, false)"
_TAGS = "array_to_string(tags, ' ')"
_FIELD = lambda c: _TAGS if c == "tag_text" else c
_ENTRY = f"(type in ('route', 'controller', 'service', 'component') or list_has_any(tags, ['route', 'controller', 'service', 'handler', 'command', 'cli']) or {_matches('lower(name)', dims.ENTRY_NAME)})"
_SEEDS = [(q, w) for q in SEARCHES for w in search.re.findall(search.SEED, q) if len(w) >= 4]
_TESTISH = f"(type = 'test' or {_TEST()})"


def _search_sql(limit: int = 20, offset: int = 0, where: str = "true") -> str:
    seed = " or ".join(f"(query = '{q}' and name = '{w}')" for q, w in _SEEDS) or "false"
    exact = [("exact_symbol_id", _SAME("id"), 1.0), ("exact_qualified_name", _SAME("qualified_name"), 0.95), ("exact_name", _SAME("name"), 0.9), ("seed_name", f"coalesce({seed}, false)", 0.98)]
    within = lambda table: "greatest(" + ", ".join(f"case when {_HAS(_FIELD(c))} then {v} else 0 end" for c, v in table.items()) + ")"
    asked = ", ".join(f"('{q}', '{p}')" for q in SEARCHES for p in search.phrases(q))
    scan = max(limit + offset, search.SCAN)
    joined = "concat_ws(' ', name, qualified_name, file_path, signature, docstring, array_to_string(tags, ' '))"
    return N + f"""
, k as (select * from n where {where}), nq as (select k.*, query, lower(query) q from k, {_Q}),
flat as (select id, t, len(string_split(trim(t), ' ')) dl from (select id, ' ' || trim(regexp_replace(lower({joined}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' t from k)), tot as (select count(*) nn, avg(dl) avgdl from flat),
hit as (select query, phrase, id, dl, (length(t) - length(replace(t, rtrim(phrase), ''))) / length(rtrim(phrase)) tf from flat, (values {asked}) a(query, phrase) where contains(t, phrase)),
df as (select query, phrase, count(*) df from hit group by all),
bm as (select query, id, row_number() over (partition by query order by round(sum(greatest(ln((nn - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) desc, id) rn from hit join df using (query, phrase), tot group by query, id),
direct as (select query, id, greatest({", ".join(f"case when {c} then {v} else 0 end" for _, c, v in exact)}) score, list_filter([{", ".join(f"case when {c} then '{k}' end" for k, c, _ in exact)}], lambda x: x is not null) sources from nq),
txt as (select query, id, case when w > 0 then w else 0.6 end score from (select nq.query, nq.id, {within(search.FTS_SCORES)} w from nq join bm on bm.query = nq.query and bm.id = nq.id and bm.rn <= {scan})),
part as (select query, id, score from (select query, id, score, row_number() over (partition by query order by name nulls first, id) rn from (select *, {within(search.LIKE_SCORES)} score from nq) where score > 0) where rn <= {scan}),
merged as (select query, id, max(score)::double score, list_distinct(flatten(list(sources))) sources from (select * from direct where score > 0 union all select query, id, score, [] from txt union all select query, id, score, [] from part) where score >= 0.2 group by query, id),
ranked as (select m.*, coalesce(file_path, '') p, count(*) over (partition by query) total, row_number() over (partition by query order by score desc, id) bs, row_number() over (partition by query order by
    case when list_contains(sources, 'exact_symbol_id') then 0 when list_contains(sources, 'exact_qualified_name') then 1 when list_contains(sources, 'exact_name') then 2 when list_contains(sources, 'seed_name') then 3 else 99 end,
    {_TESTISH}::int, (type = 'external_symbol')::int, (not {_ENTRY})::int, (not ({_PROD()} and not {_TESTISH} and type <> 'external_symbol'))::int, score desc, length(coalesce(file_path, '')), (coalesce(name = '__init__', false) or coalesce(ends_with(file_path, '__init__.py'), false))::int, {_TESTISH}::int, id) rank
  from merged m join k using (id)),
verdict as (select query, count(distinct case when list_contains(sources, 'exact_name') then p end) > 1 or (max(total) > 1 and round(max(score) - min(case when bs <= 3 then score end), 6) < 0.05) ambiguous from ranked group by query)
select query, rank::int as rank, id, score, array_to_string(list_sort(sources), ',') sources, total::int total, total > {limit + offset} truncated, ambiguous from ranked join verdict using (query) where rank > {offset} and rank <= {limit + offset}"""


_TERMS = r"""terms as (select id, term, count(*) tf from (select id, unnest(regexp_split_to_array(lower(regexp_replace(concat_ws(' ', name, qualified_name, docstring), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^\p{L}\p{N}]+')) term from n) where length(term) > 1 group by all)"""
_BM = ", ".join(f"('{q}', '{w}')" for q in SEARCHES for w in q.lower().split())
_IMPACT_PARTS = (
    EDGES_SQL,
    _reach_sql(_FN_STARTS, "incoming", 2, "cr"),
    _reach_sql(_FN_STARTS, "outgoing", 2, "ce"),
    """
own as (select *, 'caller' relation from cr union all select *, 'callee' from ce),
silent as (select id root_id from n where type = 'class' and not exists (from own o where o.root_id = n.id)),
stand as (select id, regexp_extract(id, '^(.*)[.][^.:/]+$', 1) root_id from n where type = 'method' and regexp_extract(id, '^(.*)[.][^.:/]+$', 1) in (select root_id from silent)),
lifted as (select s.root_id, o.id, arg_min(least(distance + 1, 2), (least(distance + 1, 2), -confidence)) distance, arg_min(confidence, (least(distance + 1, 2), -confidence)) confidence, relation from own o join stand s on s.id = o.root_id group by s.root_id, o.id, relation),
found as (select f.*, n.type node_type, n.file_path, f.confidence >= 0.6 confirmed from (select root_id, id, distance, confidence, relation from own union all select root_id, id, distance, confidence, relation from lifted) f left join n on n.id = f.id),
risks as (
  select s.root_id, case when sens and coalesce(n_tests, 0) + coalesce(n_up, 0) = 0 and coalesce(n_callers, 0) >= 3 and mut then 'critical' when sens or api then 'high' when coalesce(n_callers, 0) >= 5 then 'high'
    when coalesce(n_callers, 0) + coalesce(n_callees, 0) > 0 then 'medium' else 'low' end risk, coalesce(n_callers, 0) n_callers, coalesce(n_callees, 0) n_callees, coalesce(n_tests, 0) n_tests
  from (select id root_id, SENS sens, coalesce(contains(lower(file_path), '/api/'), false) or list_contains(tags, 'route') api, MUT mut from n where type in ('function', 'method', 'class')) s
  left join (select root_id, count_if(relation = 'caller') n_callers, count_if(relation = 'callee') n_callees, count_if(relation = 'caller' and node_type = 'test') n_up from found where node_type in ('function', 'method', 'class', 'test') group by root_id) c using (root_id)
  left join (select root_id, count(distinct test) n_tests from (select source root_id, target test from e where type = 'tested_by' and target in (select id from n) union all select target, source from e where type = 'calls' and source in (select id from n where type = 'test')) group by root_id) t using (root_id))""".replace(
        "SENS", f"({_WORDS('file_path', dims.SENSITIVE_WORDS)} or (list_contains(tags, 'route') and {_WORDS('name', dims.SENSITIVE_WORDS)}))"
    ).replace("MUT", _WORDS("file_path", dims.MUTATION_WORDS)),
)
_IMPACT = _with(NODES_SQL, *_IMPACT_PARTS)
_BUCKETS = f"""
, b as (select n.id, n.type, n.file_path, n.repo_id, case when best >= 0.75 then 'high' when best > 0 then 'low' when best is not null then 'unknown' else 'none' end bucket, coalesce(n_tests, 0) n_tests
  from n left join (select source id, max(confidence) best, count(distinct target) n_tests from e where type = 'tested_by' group by source) using (id) where n.type in {dims.PRODUCTION_TYPES} and not {_COVTEST("n.file_path")})
"""
_KNOWN = f"known as (select {_sql_id('id')} id from nodes union select {_sql_id('id')} from external_nodes)"
_ISSUES = (
    _with(_KNOWN, f"res as ({_RES})")
    + f""", x as (
  select edge_id, max(source) source, max(target) target, max(raw) raw, max(type) as type, max(confidence) confidence, max(resolution) resolution, max(backslash::int) = 1 backslash from (
    select id edge_id, {_sql_id("source")} source, {_sql_id("target")} target, lower(trim(type, '{BLANKS}')) raw, {_sql_type("type")} as type, confidence, metadata.resolution resolution, contains(source, '\\') or contains(target, '\\') backslash from edges) group by edge_id),
y as (select *, (source is null or source not in (select id from known where id is not null)) no_s, (target is null or target not in (select id from known where id is not null)) no_t from x),
z as (select *, case when no_s and no_t then 'missing_both' when no_s then 'missing_source' when no_t then 'missing_target' when not coalesce(type in {EDGE_TYPES}, false) then 'invalid_type' end dropped from y),
m as (
  select {_sql_id("id")} id, lower(trim(type, '{BLANKS}')) raw, {_SQL_NODE_TYPE("type")} as type, contains(file_path, '\\') backslash, location.line_start > location.line_end reversed, tags is null no_tags from nodes where {_sql_id("id")} is not null),
issues as (
  select 'edge' entity, edge_id id, dropped reason, 'dropped' as action from z where dropped is not null
  union all select 'edge', edge_id, 'type_alias', 'corrected' from z where dropped is null and raw <> type
  union all select 'edge', edge_id, 'backslash_path', 'corrected' from z where dropped is null and backslash
  union all select 'edge', edge_id, 'confidence_clamped', 'corrected' from z where dropped is null and (confidence > 1 or confidence < 0)
  union all select 'edge', edge_id, 'confidence_missing', 'corrected' from z where dropped is null and confidence is null
  union all select 'edge', edge_id, 'resolution_missing', 'warning' from z where dropped is null and resolution is null
  union all select 'edge', edge_id, 'resolution_unknown', 'warning' from z where dropped is null and resolution not in (select resolution from res)
  union all (select distinct 'node', id, 'type_alias', 'corrected' from m where raw <> type)
  union all (select distinct 'node', id, 'type_unknown', 'warning' from m where type not in {NODE_TYPES})
  union all (select distinct 'node', id, 'backslash_path', 'corrected' from m where backslash)
  union all (select distinct 'node', id, 'location_reversed', 'corrected' from m where reversed)
  union all (select distinct 'node', id, 'tags_missing', 'corrected' from m where no_tags))
"""
)
_FP = f"""fp as (
  select repo_id, snapshot_no, {_SQL_PATH("file_path")} file_path, lower(sha256) sha, lower(structural_hash) f0, lower(symbols_hash) f1, lower(imports_hash) f2, lower(calls_hash) f3 from fingerprints
  where repo_id is not null and file_path is not null qualify row_number() over (partition by repo_id, snapshot_no, {_SQL_PATH("file_path")} order by loaded_at desc nulls last) = 1),
nos as (select repo_id, snapshot_no, row_number() over (partition by repo_id order by snapshot_no desc) back from (select distinct repo_id, snapshot_no from fp)),
cur as (select fp.* from fp join nos using (repo_id, snapshot_no) where back = 1), old as (select fp.* from fp join nos using (repo_id, snapshot_no) where back = 2),
changes as (
  select coalesce(c.repo_id, s.repo_id) repo_id, coalesce(c.file_path, s.file_path) file_path,
    case when s.file_path is null then 'ADDED' when c.file_path is null then 'DELETED' when c.sha is not distinct from s.sha then 'NONE'
      when c.f0 is distinct from s.f0 or c.f1 is distinct from s.f1 or c.f2 is distinct from s.f2 or c.f3 is distinct from s.f3 then 'STRUCTURAL' else 'COSMETIC' end as change
  from cur c full join old s on c.repo_id = s.repo_id and c.file_path = s.file_path)"""
_DECOMPOSED = r"list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z]+'), lambda t: t <> ''))"
_LOW = lambda c: f"lower(coalesce({c}, ''))"
_BASE = "regexp_replace(list_last(string_split(lower(coalesce(file_path, '')), '/')), '[.][^.]*$', '')"


def _signals(w: str) -> list[list[tuple[str, float, int]]]:
    part = lambda c: f"contains({_LOW(c)}, '{w}')"
    name = _LOW("name")
    return [
        [(f"{name} = '{w}'", 0.95, 2), (f"{name} <> '' and (starts_with({name}, '{w}') or starts_with('{w}', {name}))", 0.85, 1), (part("name"), 0.8, 1)], [(f"coalesce(list_contains({_DECOMPOSED}, '{w}'), false)", 0.82, 1)],
        [(f"{_BASE} = '{w}'", 0.85, 2), (f"list_contains(regexp_split_to_array({_LOW('file_path')}, '[/.\\s]+'), '{w}')", 0.78, 1), (part("file_path"), 0.7, 1)], [(part("qualified_name"), 0.85, 1)], [(part("docstring"), 0.6, 1)], [(part("module"), 0.7, 1)],
    ]


_CASES = [g for w in search.task_words(TASK) for g in _signals(w)]
_case = lambda g, i: "case " + " ".join(f"when {x[0]} then {x[i]}" for x in g) + " else 0 end"
_RELEVANCE = f"""
, r0 as (select *, greatest({", ".join(_case(g, 1) for g in _CASES)})::double base, ({" + ".join(_case(g, 2) for g in _CASES)})::int matches from n),
r1 as (select *, case when {_ENTRY} then least(greatest(base, 0.72) + 0.1, 1.0) else base end b1 from r0),
r2 as (select *, case when type = 'test' then least(b1, 0.55) when {_TEST()} then least(b1, 0.65) else b1 end b2 from r1),
r3 as (select *, case when {_PROD()} then least(b2 + 0.03, 1.0) else b2 end b3 from r2),
r as (select *, case when matches = 0 then 0.0 else round(least(b3 + matches * 0.02, 1.0) + 1e-9, 4) end::double relevance from r3)
"""

ORACLE: dict[str, str] = {
    "graph_stats": NE
    + f"""select a.*, b.*, round(n_low_confidence / greatest(n_edges, 1), 4) low_confidence_ratio from (select count(*) n_nodes, {", ".join(f"count_if(type = '{k}')::bigint n_{k}" for k in ("file", "module", "class", "function", "method", "external_symbol"))},
  count(distinct file_path) n_files from n) a, (select count(*) n_edges, count_if(confidence < 0.6)::bigint n_low_confidence from e) b""",
    "type_counts": N + "select type, count(*) n from n group by type",
    "edge_type_counts": E + "select type, count(*) n, round(avg(confidence), 6) mean_confidence from e group by type",
    "node_filter": N + "select id, name, file_path from n where type = 'class' and contains(lower(file_path), 'src') and contains(lower(name), 'store') order by id limit 200",
    "edge_filter": E + "select edge_id, source, target from e where type = 'calls' and contains(lower(target), 'external:') order by edge_id limit 500 offset 10",
    "node_lookup": N + "select id, type, name, qualified_name from n where id = 'external:indexlib.checkGauge'",
    "edges_between": E + "select source, target, count(*) n_types, max(confidence) best from e group by all having count(*) > 1",
    "callers_direct": NE + "select c.*, n.name, n.type node_type from (select target id, count(distinct source) n_neighbors, round(avg(confidence), 6) mean_confidence from e where type = 'calls' group by target) c join n using (id)",
    "callees_direct": NE + "select c.*, n.name, n.type node_type from (select source id, count(distinct target) n_neighbors, round(avg(confidence), 6) mean_confidence from e where type = 'calls' group by source) c join n using (id)",
    "neighbors_by_role": NE
    + f"""select role, direction, count(*) n from (select direction, case when nt is null or nt = 'external_symbol' then 'external' when nt = 'test' or {_TEST()} or type = 'tested_by' then 'test' when type = 'calls' and direction = 'incoming' then 'caller'
  when type = 'calls' then 'callee' when type in ('contains', 'defined_in') then 'structure' when type = 'imports' then 'import' else 'related' end role from (
  select x.*, n.type nt, n.file_path from (select id, neighbor, arg_min(direction, (way, edge_id)) direction, arg_min(type, (way, edge_id)) as type from (
    select source id, target neighbor, 0 way, 'outgoing' direction, edge_id, type from e union all select target, source, 1, 'incoming', edge_id, type from e) group by id, neighbor) x left join n on n.id = x.neighbor)) group by all""",
    "confidence_levels": E + "select case when confidence >= 0.8 then 'high' when confidence >= 0.6 then 'medium' when confidence >= 0.4 then 'low' else 'unknown' end as level, count(*) n from e group by all",
    "resolution_tiers": E + "select resolution, n, case tier when 'none' then 'unresolved' else coalesce(tier, 'unresolved') end tier, coalesce(blocks, false) blocks from (select resolution, count(*) n from e where resolution is not null group by resolution) left join res using (resolution)",
    "transitive_callers_d2": _with(NODES_SQL, EDGES_SQL, _reach_sql(_ALL_STARTS, "incoming", 2)) + "select root_id, id, distance, round(confidence, 6) confidence from reach",
    "transitive_callees_d2": _with(NODES_SQL, EDGES_SQL, _reach_sql(_FN_STARTS, "outgoing", 2)) + "select root_id, id, distance, round(confidence, 6) confidence from reach",
    "callees_with_missing": NE + "select source root_id, target in (select id from n) known, count(distinct target) n from e where type = 'calls' and confidence >= 0.6 and source in (select id from n where type in ('function', 'method')) and source <> target group by all",
    "subgraph_edges": _with(
        NODES_SQL, EDGES_SQL, _reach_sql(_ALL_STARTS, "outgoing", 1, links="select source at_, target to_, max(confidence) confidence from (select source, target, confidence from e union all select target, source, confidence from e) group by all")
    )
    + ", near as (select root_id, id from reach union select root_id, id from reach_0) select s.root_id, e.source, e.target, e.type from e join near s on s.id = e.source join near t on t.id = e.target and t.root_id = s.root_id",
    "file_overview": N + "select file_path, count_if(type not in ('file', 'module'))::bigint n_symbols, count_if(type in ('function', 'method'))::bigint n_functions, count_if(type = 'class')::bigint n_classes, count_if(type = 'test')::bigint n_tests, max(language_id) as language from n where file_path is not null group by file_path",
    "cross_file_edges": NE + ", x as materialized (select e.target, s.file_path source_file from e join n s on s.id = e.source where s.file_path is not null) select source_file, t.file_path target_file, count(*) n_edges from x join n t on t.id = x.target where t.file_path is not null group by all having source_file <> target_file",
    "entry_points_topk": NE
    + f"""select id, name, type, degree from (select id, count(*) degree from (select source id from e union all select target from e) group by id) join n using (id)
  where type not in ('test', 'file', 'module', 'external_symbol') and not {_TEST()} and not coalesce(name in ('__init__', 'constructor'), false)
  order by degree desc, case type when 'route' then 5 when 'controller' then 4 when 'service' then 3 when 'class' then 2 when 'function' then 1 else 0 end desc, length(file_path), id limit 6""",
    "relation_counts": NE
    + """select n.id, n.type, coalesce(n_callers, 0) n_callers, coalesce(n_impact_files, 0) n_impact_files, coalesce(n_callees, 0) n_callees, coalesce(n_tests, 0) n_tests from n
  left join (select target id, count(distinct source) n_callers, count(distinct s.file_path) n_impact_files from e left join n s on s.id = e.source where e.type = 'calls' group by target) a using (id)
  left join (select source id, count(distinct target) n_callees from e where type = 'calls' group by source) b using (id) left join (select source id, count(distinct target) n_tests from e where type = 'tested_by' group by source) c using (id)
  where n.type not in ('file', 'module', 'external_symbol')""",
    "class_members": N + "select c.id class_id, c.name, count(m.id) n_methods, min(m.line_start) first_line from n c left join n m on m.type = 'method' and regexp_extract(m.id, '^(.*)[.][^.:/]+$', 1) = c.id where c.type = 'class' group by all",
    "repo_summary_current": NE
    + f"""select a.*, coalesce(n_edges, 0) n_edges, low_confidence_ratio from (select repo_id, count(distinct file_path) n_files, count_if(type not in ('file', 'module'))::bigint n_symbols, count_if(type in ('function', 'method'))::bigint n_functions, count_if(type = 'class')::bigint n_classes,
  count(distinct language_id) n_languages, count_if({_TEST()})::bigint n_test_nodes from n where repo_id is not null group by repo_id) a
  left join (select repo_id, count(*) n_edges, round(avg(case when confidence < 0.6 then 1.0 else 0.0 end), 4) low_confidence_ratio from e join n on n.id = e.source group by repo_id) using (repo_id)""",
    "low_conf_ratio_by_language": NE + "select coalesce(language_id, 'unknown') as language, count(*) n_edges, round(avg(confidence), 6) mean_confidence, count_if(confidence < 0.6)::bigint n_low from e join n on n.id = e.source group by all",
    "external_resolve": NE
    + """, lookup as (select qualified_name, arg_min(id, (-p, id)) resolved from (select *, case when type in ('function', 'method', 'class', 'test') then 3 when type in ('module', 'file') then 1 when type = 'import' then 0 else -1 end p from n where qualified_name is not null and type <> 'external_symbol') where p >= 0 group by qualified_name)
, raw as (select source, target, type, resolution from e union all select e.source, 'external:' || n.qualified_name, e.type, e.resolution from e join n on n.id = e.target where e.type = 'calls' and n.qualified_name is not null)
select distinct source, target, resolved from raw e join lookup on qualified_name = substring(target, 10) where type = 'calls' and starts_with(target, 'external:')
  and not coalesce(resolution in ('name_match_candidate', 'callback_candidate', 'unknown_receiver_method', 'dynamic_dispatch', 'unknown_symbol', 'unresolved'), false)""",
    "test_edge_prefix_match": N
    + """, t as (select id test_id, repo_id, substring(name, 6) rest from (select id, type, name, repo_id from n union all select 'test of ' || id, 'test', 'test_' || name || '_twice', repo_id from n where type in ('function', 'method', 'class')) where type in ('function', 'method', 'test') and starts_with(name, 'test_'))
select arg_min(c.id, (-length(c.name), c.id)) source, test_id target, 0.65::double confidence from t join n c on c.repo_id = t.repo_id and c.type in ('function', 'method', 'class') and not starts_with(c.name, 'test_') and (t.rest = c.name or starts_with(t.rest, c.name || '_')) group by test_id""",
    "star_dependencies": NE
    + """, k as (select id, case when list_contains(tags, 'model') then 'model' when list_contains(tags, 'config') then 'config' when list_contains(tags, 'store') or list_contains(tags, 'persistence') then 'store' end kind from n where type = 'class')
select f.file_path, kind, count(distinct target) n_dependencies from e join k on k.id = e.target and kind is not null join n f on f.id = e.source where f.file_path is not null and e.type in ('imports', 'references', 'depends_on', 'inherits', 'calls') group by all""",
    "related_tests": NE
    + f"""select id, test_id, case arg_min(way, (way, -confidence)) when 0 then 'tested_by' else 'calls' end via, round(arg_min(confidence, (way, -confidence)), 6) confidence from (
  select source id, target test_id, confidence, 0 way from e where type = 'tested_by' union all select target, source, confidence, 1 from e where type = 'calls' and source in (select id from n where type = 'test' or {_COVTEST()})) group by id, test_id""",
    "edge_dedup_first_wins": E + "select edge_id, source, target, type from e",
    "edge_type_normalize": f"select type raw, {_sql_type('type')} canonical, count(*) n from edges group by all",
    "node_type_normalize": f"select type raw, {_SQL_NODE_TYPE('type')} canonical, count(*) n from nodes group by all",
    "validation_issues": _ISSUES + "select * from issues",
    "breakdown_by_reason": _ISSUES + "select entity, reason, action, count(*) n, min(id) first_id, max(id) last_id from issues group by all",
    "validation_health": _ISSUES
    + """select n_edges, n_dropped, n_corrected, n_warnings, round(n_dropped / greatest(n_edges, 1), 4) dropped_ratio, case when n_edges = 0 then 'error' when n_dropped > 0 or n_warnings > 0 then 'warning' else 'ok' end status from (select count(distinct id) n_edges from edges),
  (select count_if(entity = 'edge' and action = 'dropped')::bigint n_dropped, count_if(action = 'corrected')::bigint n_corrected, count_if(action = 'warning')::bigint n_warnings from issues)""",
    "dangling_edges": _ISSUES + "select id, reason from issues where reason in ('missing_source', 'missing_target', 'missing_both')",
    "orphan_ratio": NE + "select type, count(*) n_nodes, count_if(t.id is null)::bigint n_isolated, round(count_if(t.id is null) / count(*), 4) ratio from n left join (select source id from e union select target from e) t using (id) group by type",
    "coverage_buckets": NE + _BUCKETS + "select id, bucket, n_tests from b",
    "coverage_by_file": NE + _BUCKETS + "select * from (select file_path, count(*) n_symbols, count_if(bucket = 'high')::bigint n_high, count_if(bucket = 'low')::bigint n_low, count_if(bucket in ('none', 'unknown'))::bigint n_uncovered from b where file_path is not null group by file_path) where n_uncovered > 0 or n_high + n_low = 0",
    "coverage_summary": NE + _BUCKETS
    + """select *, case when n_high * 2 >= n then 'high' when n_high > 0 or (n_low > 0 and (n_high + n_low) * 10 >= n * 3) then 'medium' when n_low > 0 or n_unknown > 0 then 'low' else 'unknown' end confidence from (
  select repo_id, count(*) n, count_if(bucket = 'high')::bigint n_high, count_if(bucket = 'low')::bigint n_low, count_if(bucket = 'unknown')::bigint n_unknown, count_if(bucket = 'none')::bigint n_none from b where repo_id is not null group by repo_id)""",
    "coverage_signal": NE
    + f"""select *, case when n_tested = 0 then case when n_test_files = 0 then 'unknown' else 'incomplete' end when n_high = 0 then 'low_confidence' when n_high * 2 >= n_tested then 'ok' else 'low_confidence' end status from (
  select r.repo_id, coalesce(n_test_files, 0) n_test_files, coalesce(n_tested, 0) n_tested, coalesce(n_high, 0) n_high from (select distinct repo_id from n where repo_id is not null) r
  left join (select repo_id, count(distinct file_path) n_test_files from n where {_COVTEST()} group by repo_id) using (repo_id)
  left join (select repo_id, count(distinct source) n_tested, count(distinct case when confidence >= 0.75 then source end) n_high from e join n on n.id = e.source where e.type = 'tested_by' group by repo_id) using (repo_id))""",
    "search_inmemory": N + f"select query, id, score from (select query, id, {_PLAIN} score from (select n.*, query, lower(query) q from n, {_Q})) where score > 0",
    "search_multipass": _search_sql(),
    "search_paged": _search_sql(7, 5),
    "search_filtered": _search_sql(where=f"type in ('function', 'method', 'class') and not {_matches('file_path', '^.*/test.*$')} and coalesce(language_id in ('python', 'go'), false) and type <> 'test' and not {_TEST()}"),
    "external_calls": NE
    + """, ends as (select source id, target other, 0 way, edge_id, confidence, resolution from e where type = 'calls' union all select target, source, 1, edge_id, confidence, resolution from e where type = 'calls')
select id, other, case way when 0 then 'target' else 'source' end as role, confidence, coalesce(resolution, 'unknown') resolution, case tier when 'none' then 'unresolved' else coalesce(tier, 'unresolved') end category from (
  select x.*, row_number() over (partition by x.id, other order by way, edge_id) rn from ends x join n on n.id = x.id left join n o on o.id = x.other
  where o.id is null or o.type = 'external_symbol' or coalesce((select blocks from res where res.resolution = x.resolution), false)) left join res using (resolution) where rn = 1""",
    "bm25_topk": _with(NODES_SQL, _TERMS)
    + f""", sizes as (select id, sum(tf) dl from terms group by id), tot as (select count(*) nn, avg(dl) avgdl from sizes), df as (select term, count(*) df from terms group by term), qs as (select * from (values {_BM}) t(query, term))
select query, id, score, rank::int as rank from (select query, id, score, row_number() over (partition by query order by score desc, id) rank from (
  select query, id, round(sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)))), 4) score from terms join qs using (term) join df using (term) join sizes using (id), tot group by query, id)) where rank <= 10""",
    "fts_terms": _with(NODES_SQL, _TERMS) + "select term, count(*) df, sum(tf)::bigint tf from terms group by term",
    "name_decompose": N + f"select name, array_to_string(list_sort({_DECOMPOSED}), ' ') parts from (select distinct name from n where name is not null)",
    "tokenize": rf"""select doc_id, len(list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+')), lambda t: length(t) > 2 and not list_contains([{", ".join(f"'{w}'" for w in search.STOPWORDS)}], t)))::int n_words,
  case when length(text) = 0 then 0 else greatest(length(text) // 4, 1) end::bigint n_tokens from documents where text is not null""",
    "relevance_score": N + _RELEVANCE + "select id, name, relevance score, matches from r where relevance > 0 order by relevance desc, id limit 20",
    "context_item_score": _with(NODES_SQL, EDGES_SQL)
    + _RELEVANCE
    + """select id, round(least(greatest(0.35 * relevance + 0.20 * case when degree >= 50 then 1.0 when degree >= 10 then 0.85 when degree >= 3 then 0.6 else 0.3 end + 0.15 * coalesce(mc, 0) + 0.15 * case when list_contains(tags, 'route') then 0.9 else 0.8 end
  + case when type = 'test' then 0.05 else 0 end - 0.05 * 0.2 - 0.05 * least(coalesce(length(code_preview), 0) / 2000.0, 1.0), 0.0), 1.0)::double + 1e-9, 4) score
  from r left join (select id, count(*) degree, round(avg(confidence), 6) mc from (select source id, confidence from e union all select target, confidence from e) group by id) using (id) where type not in ('file', 'module', 'external_symbol')""",
    "impact_confirmed": _IMPACT + "select root_id, relation, count_if(confirmed)::bigint n_confirmed, count_if(not confirmed)::bigint n_possible from found group by all",
    "impact_files": _IMPACT + "select root_id, file_path, min(distance) distance, count(distinct id) n_symbols from found where confirmed and file_path is not null group by all",
    "impact_risk": _IMPACT + "select * from risks",
    "pre_edit_batch": _IMPACT
    + """select w.file_path, ['low', 'medium', 'high', 'critical'][r] risk, coalesce(n_symbols, 0) n_symbols, coalesce(n_files, 0) n_files from (select n.file_path, max(list_position(['low', 'medium', 'high', 'critical'], risk)) r from risks join n on n.id = risks.root_id where n.file_path is not null group by n.file_path) w
  left join (select n.file_path, count(distinct found.id) n_symbols, count(distinct found.file_path) n_files from found join n on n.id = found.root_id where confirmed and n.file_path is not null group by n.file_path) using (file_path)""",
    "change_classify": _with(_FP) + "select * from changes",
    "incremental_plan": _with(_FP)
    + """select *, case when n_structural + n_added + n_deleted = 0 then 'skip' when n_structural + n_added + n_deleted > 30 or n_structural + n_added + n_deleted > 0.3 * n_files then 'full' else 'incremental' end mode from (select repo_id, count(*) n_files, count_if(change = 'NONE')::bigint n_none,
  count_if(change = 'COSMETIC')::bigint n_cosmetic, count_if(change = 'STRUCTURAL')::bigint n_structural, count_if(change = 'ADDED')::bigint n_added, count_if(change = 'DELETED')::bigint n_deleted from changes group by repo_id)""",
    "dependents": _with(NODES_SQL, EDGES_SQL, _FP)
    + ", changed as (select distinct file_path from changes where change in ('STRUCTURAL', 'DELETED')) select distinct s.file_path from e join n t on t.id = e.target and t.file_path in (select file_path from changed) join n s on s.id = e.source where e.type = 'imports' and s.file_path is not null and s.file_path not in (select file_path from changed)",
    "incremental_remove": _with(NODES_SQL, EDGES_SQL, _FP)
    + """, gone as (select id from n where file_path in (select file_path from changes where change in ('STRUCTURAL', 'DELETED'))), k as (select * from n where id not in (select id from gone)), ke as (select * from e where source not in (select id from gone) and target not in (select id from gone))
select repo_id, n_nodes, coalesce(n_edges, 0) n_edges from (select repo_id, count(*) n_nodes from k where repo_id is not null group by repo_id) left join (select repo_id, count(*) n_edges from ke join k on k.id = ke.source group by repo_id) using (repo_id)""",
    "enrichment_status": N + "select repo_id, count(*) n_symbols, count_if(h)::bigint n_documented, count(distinct case when h then file_path end) n_files_documented from (select *, coalesce(length(trim(docstring)), 0) > 0 h from n) where repo_id is not null and type not in ('file', 'module') group by repo_id",
    "enrichment_merge": N
    + r"""select id, case when d then substring(regexp_extract(docstring, '([^\n\r]*)', 1), 1, 500) end summary, array_to_string(case when d then (list_transform(tags, lambda t: lower(t)) || case when list_contains(list_transform(tags, lambda t: lower(t)), type) then [] else [type] end)[1:10] else tags end, ',') tags
  from (select *, coalesce(length(trim(docstring)), 0) > 0 d from n)""",
    "enrichment_issues": N
    + """select case when symbol is null then 'no_symbol' when n.id is null then 'unknown_symbol' when coalesce(length(trim(summary)), 0) = 0 then 'no_summary' when length(summary) > 500 then 'long_summary' else 'ok' end issue, count(*) n from (
  select j ->> '$.symbol' symbol, j ->> '$.summary' summary from (select try_cast(nullif(trim(text), '') as json) j from documents where source = 'api_summary')) left join n on n.id = symbol group by all""",
    "snippets": N
    + r""", f as (select file_path, regexp_split_to_array(decode(content), '\r\n|\r|\n') lines from source_files qualify row_number() over (partition by file_path order by loaded_at desc nulls last) = 1)
select id, array_to_string(lines[line_start:line_start + least(line_end - line_start + 1, 5) - 1], chr(10)) snippet from n join f using (file_path) where type in ('function', 'method') and line_start > 0 and len(lines) >= line_start""",
    "path_flags": N
    + f"""select file_path, case {" ".join(f"when {_matches('lower(file_path)', p)} then '{l}'" for l, p in dims.LAYERS)} else 'unknown' end layer, case lower(regexp_extract(file_path, '[.]([^./]+)$', 1)) {" ".join(f"when '{x}' then '{l}'" for x, l in dims.EXTENSIONS.items())} end as language,
  {_TEST()} test, {_COVTEST()} coverage_test, {_PROD()} production, {_matches("file_path", "(^|/)(" + "|".join(w.replace(".", "[.]") for w in dims.EXCLUDED_FOLDERS) + ")/")} excluded, {_WORDS("file_path", dims.SENSITIVE_WORDS)} sensitive from n where type = 'file' and file_path is not null""",
}
