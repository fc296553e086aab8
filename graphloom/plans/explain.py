"""Queries of explanation, contexts and integrity, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import EDGE_TYPES, clean_path
from graphloom.operators import context, explain, impact, integrity, search, validation
from graphloom.plans.graph import _COVTEST, _ISSUES, _RELEVANCE, _SQL_NODE_TYPE, _SQL_PATH, _TERMS, EDGES_SQL, N, NE, NODES_SQL, TASK, _ne, _n, _e, _with, edges, nodes, validate
from graphloom.plans.general import _sql_id, _sql_type
from graphloom.runtime import cut, table

WORDS = explain.SIGNALS


def context_items(spark: SparkSession, d: str) -> DataFrame:
    n, e = nodes(spark, d), edges(spark, d)
    return impact.context_items(n, e, cut(context.entries(n, TASK).select("id")), TASK)


def artifact_counts(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    prints = table(spark, d, "fingerprints").select(clean_path(F.col("file_path")).alias("file_path"))
    return integrity.artifact_counts(n, edges(spark, d), search.terms(n), prints)


def repaired(spark: SparkSession, d: str) -> DataFrame:
    """What is left after repair: rows per table and type."""
    n, e = integrity.repair(*[table(spark, d, t) for t in ("nodes", "edges", "external_nodes")])
    count = lambda df, name: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(name).alias("of"), "type", "n")
    return count(n, "nodes").unionByName(count(e, "edges"))


QUERIES = {
    "symbol_summaries": _n(explain.summaries),
    "implementation_signals": _ne(explain.signals),
    "relationships_top5": _ne(explain.relationships),
    "edge_quality": _e(explain.quality),
    "graph_warnings": _ne(integrity.graph_warnings),
    "drop_assessment": lambda s, d: integrity.assessment(validation.breakdown(validate(s, d))),
    "artifact_counts": artifact_counts,
    "repaired": repaired,
    "context_items": context_items,
    "context_entries": _n(lambda n: context.entries(n, TASK)),
}

_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_LINE = f"split_part({_TRIM('docstring')}, chr(10), 1)"
_HIT = lambda c, words: "coalesce(" + " or ".join(f"contains(lower({c}), '{w}')" for w in words) + ", false)"
_HUMPS = r"lower(replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '))"
_VERB = f"case split_part({_HUMPS}, ' ', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in explain.VERBS.items()) + " end"
_SYMBOL = "type not in ('file', 'module', 'external_symbol')"
_ENDS = "ends as (select source id, target other, 0 way, type, confidence from e union all select target, source, 1, type, confidence from e)"
_TIERS = "(select case (select tier from res where res.resolution = e.resolution) when 'none' then 'unresolved' else coalesce((select tier from res where res.resolution = e.resolution), 'unresolved') end)"
_ENTRY_IDS = f"ent as (select id, relevance from r where {_SYMBOL} and relevance > 0 order by relevance desc, id limit {context.ENTRIES})"
ORACLE = {
    "symbol_summaries": N
    + f"""select id, coalesce(said, named, plain) summary, case when said is not null then 'docstring' when named is not null then 'name' else 'type' end origin from (select id,
  nullif(substring({_TRIM(f"case when strpos({_LINE}, '. ') > 0 then substring({_LINE}, 1, strpos({_LINE}, '. ')) else {_LINE} end")}, 1, 160), '') said,
  case when not starts_with(name, '__') and contains({_HUMPS}, ' ') and {_VERB} is not null then {_VERB} || ' ' || substring({_HUMPS}, strpos({_HUMPS}, ' ') + 1) || '.' end named,
  upper(type[1]) || type[2:] || ' ' || coalesce(name, '?') || '.' plain from n where {_SYMBOL})""",
    "implementation_signals": NE
    + f""", c as (select source id, {", ".join(f"bool_or({_HIT('t', w)}) {k}" for k, w in WORDS.items())} from (select source, regexp_extract(target, '([^:.]*)$', 1) t from e where type in ('calls', 'imports')) group by source)
select n.id, {", ".join(f"{_HIT('code_preview', w)} or coalesce({k}, false) {k}" for k, w in WORDS.items())}, type in ('route', 'controller') or list_contains(tags, 'route') is_framework_entry, {_COVTEST()} is_test_code
from n left join c using (id) where type in ('function', 'method', 'class', 'route', 'controller')""",
    "relationships_top5": NE
    + f""", {_ENDS}, k as (select id, kind, other, max(confidence) c from (select *, case when type = 'calls' then case way when 0 then 'callees' else 'callers' end when type = 'tested_by' and way = 0 then 'tests' when type = 'inherits' and way = 0 then 'parents' when type = 'references' then 'references' end kind from ends)
  where kind is not null and id in (select id from n where {_SYMBOL}) group by all)
select id, kind, count(*) n, string_agg(case when rn <= 5 then other end, ',' order by rn) best from (select *, row_number() over (partition by id, kind order by c desc, other) rn from k) group by id, kind""",
    "edge_quality": _with(EDGES_SQL)
    + f"""select count(*) n_edges, {", ".join(f"count_if(tier = '{t}')::bigint n_{t}" for t in ("confirmed", "possible", "unresolved"))}, count_if(confidence < 0.6)::bigint n_low, round(avg(confidence), 6) mean_confidence from (
  select e.*, case r.tier when 'none' then 'unresolved' else coalesce(r.tier, 'unresolved') end tier from e left join res r on r.resolution = e.resolution)""",
    "graph_warnings": NE
    + """, a as (select count(*) n, count_if(t.id is null) alone from n left join (select source id from e union select target from e) t using (id)), b as (select count(*) m, count_if(starts_with(target, 'external:')) ext, count_if(confidence < 0.6) low from e),
v as (select n, round(alone / greatest(n, 1), 4) o, round(ext / greatest(m, 1), 4) x, round(low / greatest(m, 1), 4) l from a, b)
select 'no_nodes' as rule, n::double as value, case when n = 0 then 'fatal' else 'ok' end as level from v union all select 'orphan_ratio', o, case when o > 0.5 then 'warning' else 'ok' end from v
union all select 'external_ratio', x, case when x > 0.3 then 'warning' else 'ok' end from v union all select 'low_confidence_ratio', l, case when l > 0.5 then 'warning' else 'ok' end from v""",
    "drop_assessment": _ISSUES
    + """select reason, n, case when reason in ('missing_source', 'missing_both') then 'callers are lost' when reason = 'missing_target' then 'callees are lost' when reason = 'invalid_type' then 'relations are not traversed' else 'none' end meaning,
  case when starts_with(reason, 'missing') then 'index the repository again' when reason = 'invalid_type' then 'add the type to the aliases' else 'nothing' end as next, case when n > 100 then 'high' when n > 10 then 'medium' else 'low' end severity
from (select reason, count(*) n from issues where action = 'dropped' group by entity, reason)""",
    "artifact_counts": _with(NODES_SQL, EDGES_SQL, _TERMS)
    + f""" select 'nodes' artifact, count(*) n from n union all select 'edges', count(*) from e union all select 'nodes_without_terms', count(*) from n where (name is not null or qualified_name is not null or docstring is not null) and id not in (select id from terms)
union all select 'files_without_fingerprint', count(distinct file_path) from n where type = 'file' and file_path is not null and file_path not in (select {_SQL_PATH("file_path")} from fingerprints where {_SQL_PATH("file_path")} is not null)""",
    "repaired": f"""with kn as (select {_sql_id("id")} id from nodes where {_sql_id("id")} is not null union select {_sql_id("id")} from external_nodes),
x as (select {_sql_id("source")} source, {_sql_id("target")} target, {_sql_type("type")} as type from edges)
select 'nodes' as of, {_SQL_NODE_TYPE("type")} as type, count(*) n from nodes where {_sql_id("id")} is not null group by all
union all select 'edges', type, count(*) from x where type in {EDGE_TYPES} and source in (select id from kn where id is not null) and (starts_with(target, 'external:') or target in (select id from kn where id is not null)) group by all""",
    "context_entries": N + _RELEVANCE + f", {_ENTRY_IDS} select * from ent",
    "context_items": _with(NODES_SQL, EDGES_SQL)
    + _RELEVANCE
    + f""", {_ENTRY_IDS},
near as (select target id, type edge, true o, confidence from e where source in (select id from ent) union all select source, type, false, confidence from e where target in (select id from ent) and source not in (select id from ent)),
it as (select r.*, o, confidence, case when edge = 'tested_by' or type = 'test' then 'test' when type = 'class' and list_contains(tags, 'model') then 'model' when type = 'class' and list_contains(tags, 'config') then 'config'
  when type = 'class' and (list_contains(tags, 'store') or list_contains(tags, 'persistence')) then 'store' when edge = 'calls' and o then 'callee' when edge = 'calls' then 'caller' end relation from near join r using (id) where id not in (select id from ent)),
im as (select *, case when relation = 'callee' and confidence >= 0.75 then 'high' when relation in ('callee', 'test') then 'medium' else 'low' end importance from it where relation is not null),
sc as (select *, round(least(greatest(0.35 * relevance + 0.20 * case importance when 'high' then 0.85 when 'medium' then 0.6 else 0.3 end + 0.15 * confidence
  + 0.15 * (case relation when 'callee' then 0.8 when 'model' then 0.7 when 'config' then 0.7 when 'test' then 0.4 else 0.6 end + case when list_contains(tags, 'route') then 0.1 else 0 end) + case when type = 'test' then 0.05 else 0 end - 0.05 * 0.2
  - 0.05 * least(coalesce(length(code_preview), 0) / 2000.0, 1.0), 0.0), 1.0)::double + 1e-9, 4) score, case when confidence < 0.6 then 5 when relation = 'callee' and importance = 'high' then 1 when relation = 'test' then 2 when relation in ('model', 'config', 'store') then 3 else 4 end tier from im)
select id, relation, importance, confidence, tier, score from sc qualify row_number() over (partition by id order by tier, score desc, relation) = 1""",
}
