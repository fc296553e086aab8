"""Queries of the general operators for training data, p1, p2, p5 and p6, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.keys import BLANKS, EDGE_ALIASES, clean_id, clean_path, edge_type, spellings, strip
from graphloom.operators.hierarchy import descendant_counts, hierarchy
from graphloom.operators.orphans import orphan_cascade, orphan_report
from graphloom.operators.skewed_groups import balanced_group_stats
from graphloom.operators.snapshot_diff import snapshot_changes
from graphloom.runtime import cut, table

HEAVY_SHARE = 0.02


def p1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "fingerprints"), clean_path(F.col("file_path")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_changes(spark, sf_dir).select("repo_id", "snapshot_no", "file_path", "change")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_changes(spark, sf_dir).groupBy("repo_id", "snapshot_no", "change").agg(F.count("*").alias("n_files"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_cascade(*[table(spark, sf_dir, t) for t in ("edges", "nodes", "external_nodes")])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).where("relation = 'direct'").select("edge_id", "side", "kind")


def p2_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("edge_id", "side", "relation", "hops")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges").where(F.lower(strip(F.col("type"))).isin(spellings(("contains",), EDGE_ALIASES)))
    return e.select(clean_id(F.col("source")).alias("parent"), clean_id(F.col("target")).alias("child"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(_contains(spark, sf_dir))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendant_counts(hierarchy(_contains(spark, sf_dir), with_paths=True, with_cycles=True))


def p6_target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    key = [clean_id(F.col("target")).alias("target"), edge_type(F.col("type")).alias("type")]
    return balanced_group_stats(table(spark, sf_dir, "edges"), key, clean_id(F.col("source")), F.col("id"), F.when(F.col("confidence").isNotNull(), conf), F.col("loaded_at"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(p6_target_stats(spark, sf_dir).select("target", "type", "n_edges"))
    total = stats.agg(F.sum("n_edges")).first()[0] or 0
    return stats.where((F.col("n_edges") >= HEAVY_SHARE * total) & F.col("target").isNotNull()).select("target", "type")


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p1_report, p2_found, p2_orphans, p2_report, p5_found, p5_paths, p6_found, p6_target_stats)}


def _sql_id(c: str) -> str:
    return f"nullif(trim(replace({c}, '\\', '/'), '{BLANKS}'), '')"


def _sql_type(c: str) -> str:
    x = f"lower(trim({c}, '{BLANKS}'))"
    return f"case {x} " + " ".join(f"when '{a}' then '{b}'" for a, b in EDGE_ALIASES.items()) + f" else {x} end"


_INSIDE = f"{_sql_type('type')} = 'contains'"

_P1 = f"""
with clean as (
  select repo_id, snapshot_no, regexp_replace({_sql_id("file_path")}, '^([.]/)+', '') as file_path, loaded_at,
         lower(trim(sha256)) c, lower(trim(structural_hash)) f0, lower(trim(symbols_hash)) f1, lower(trim(imports_hash)) f2, lower(trim(calls_hash)) f3
  from fingerprints where repo_id is not null and snapshot_no is not null and file_path is not null),
last as (select * from clean qualify row_number() over (partition by repo_id, snapshot_no, file_path order by loaded_at desc nulls last) = 1),
snaps as (select repo_id, snapshot_no, lag(snapshot_no) over (partition by repo_id order by snapshot_no) pv from (select distinct repo_id, snapshot_no from last)),
pairs as (select * from snaps where pv is not null),
b as (select p.repo_id, p.snapshot_no, l.* exclude (repo_id, snapshot_no, loaded_at) from pairs p join last l on l.repo_id = p.repo_id and l.snapshot_no = p.snapshot_no),
a as (select p.repo_id, p.snapshot_no, l.* exclude (repo_id, snapshot_no, loaded_at) from pairs p join last l on l.repo_id = p.repo_id and l.snapshot_no = p.pv),
j as (
  select coalesce(a.repo_id, b.repo_id) repo_id, coalesce(a.snapshot_no, b.snapshot_no) snapshot_no, coalesce(a.file_path, b.file_path) file_path,
    a.file_path is null as fresh, b.file_path is null as gone, a.c is distinct from b.c as differs,
    a.f0 is distinct from b.f0 d0, a.f1 is distinct from b.f1 d1, a.f2 is distinct from b.f2 d2, a.f3 is distinct from b.f3 d3
  from a full join b on a.repo_id = b.repo_id and a.snapshot_no = b.snapshot_no and a.file_path = b.file_path),
r as (
  select repo_id, snapshot_no, file_path, case when fresh then 'added' when gone then 'removed' when d0 or d1 or d2 or d3 then 'structural' else 'cosmetic' end as change,
    case when not fresh and not gone then d0 end structural_hash_changed, case when not fresh and not gone then d1 end symbols_hash_changed,
    case when not fresh and not gone then d2 end imports_hash_changed, case when not fresh and not gone then d3 end calls_hash_changed
  from j where fresh or gone or differs)
"""

_ENDS = f"""
ends as (
  select distinct id edge_id, 'source' side, {_sql_id("source")} ref, indexed_at t from edges where {_sql_id("source")} is not null
  union select distinct id, 'target', {_sql_id("target")}, indexed_at from edges where {_sql_id("target")} is not null)"""

_P2 = f"""
with recursive {_ENDS},
life as (select {_sql_id("id")} id, indexed_at since, removed_at until from nodes union select {_sql_id("id")}, indexed_at, removed_at from external_nodes),
direct as (
  select edge_id, side, ref, t, case when not known then 'missing' when begun then 'deleted' else 'late' end kind from (
    select edge_id, side, ref, t, max((l.id is not null)::int) = 1 known, max(coalesce(l.since <= t, false)::int) = 1 begun,
      max(coalesce(l.since <= t and (l.until is null or l.until > t), false)::int) = 1 alive
    from ends left join life l on l.id = ref group by all) where not alive)
"""

_P2_ALL = (
    _P2
    + f""",
links as (select distinct id edge_id, {_sql_id("source")} p, {_sql_id("target")} c from edges where {_INSIDE} and {_sql_id("source")} is not null and {_sql_id("target")} is not null),
fall as (
  select c ref, 1 hops from links l join direct d on d.edge_id = l.edge_id and d.side = 'source'
  union select l.c, hops + 1 from fall f join links l on l.p = f.ref where hops < 200),
found as (select ref, min(hops) hops from fall group by ref),
orphans as (
  select edge_id, side, kind, 'direct' relation, 0 hops, t from direct
  union all select e.edge_id, e.side, 'inherited', 'inherited', hops, e.t from ends e join found using (ref)
  where not exists (from direct d where d.edge_id = e.edge_id and d.side = e.side))
"""
)

_P5 = f"""
with recursive raw as (select {_sql_id("source")} p, {_sql_id("target")} c from edges where {_INSIDE}),
ids as (select id, min(up) up from (select c id, p up from raw union all select p, null from raw) where id is not null group by id),
walk as (
  select id node_id, id root_id, 0 depth, id path from ids where up is null
  union all select i.id, w.root_id, w.depth + 1, w.path || ' > ' || i.id from walk w join ids i on i.up = w.node_id),
lost as (select id, up from ids where not exists (from walk where node_id = id)),
chase as (select id start, id cur, [id] seen from lost union all select start, up, list_append(seen, up) from chase join lost on lost.id = cur where not list_contains(seen, up)),
cycle_of as (
  select start, list_min(seen[list_position(seen, up):]) smallest from (
    select start, arg_max(seen, len(seen)) seen from chase group by start) join lost on lost.id = seen[-1])
"""

#: Pairs of an ancestor and a node: above nodes of trees, and above those on or below a cycle.
_P5_PAIRS = """, up as (
  select id node_id, up anc, 1 steps from ids where up is not null and not exists (from lost where lost.id = ids.id) union all select u.node_id, i.up, steps + 1 from up u join ids i on i.id = u.anc where i.up is not null),
longest as (select start, arg_max(seen, len(seen)) seen from chase group by start),
pairs as (
  select anc ancestor_id, node_id descendant_id, steps from up
  union all select unnest(seen[2:]), start, unnest(range(1, len(seen)))::int from longest)
"""

_P6 = f"""
with one as (
  select id, {_sql_id("target")} target, {_sql_type("type")} as type, {_sql_id("source")} source, case when confidence is not null then least(greatest(confidence, 0), 1) end confidence
  from edges qualify row_number() over (partition by id order by loaded_at desc nulls last) = 1)
"""

ORACLE = {
    "p1_found": _P1 + "select repo_id, snapshot_no, file_path, change from r",
    "p1_changes": _P1 + "select * from r",
    "p1_report": _P1 + "select repo_id, snapshot_no, change, count(*) n_files from r group by all",
    "p2_found": _P2 + "select edge_id, side, kind from direct",
    "p2_orphans": _P2_ALL + "select edge_id, side, relation, hops from orphans",
    "p2_report": _P2_ALL
    + """select 'edges.' || side as reference, strftime(t, '%Y-%m') as month, sum((kind = 'missing')::int)::bigint as missing, sum((kind = 'deleted')::int)::bigint as deleted,
  sum((kind = 'late')::int)::bigint as late, sum((relation = 'direct')::int)::bigint as direct, sum((relation = 'inherited')::int)::bigint as inherited from orphans group by all""",
    "p5_found": _P5 + "select node_id, root_id, depth from walk union all select start, smallest, -1 from cycle_of",
    "p5_paths": _P5
    + _P5_PAIRS
    + """, n as (select node_id, root_id, depth, path from walk union all select start, smallest, -1, start from cycle_of)
select n.*, coalesce(k, 0) n_descendants from n left join (select ancestor_id, count(*) k from pairs group by ancestor_id) on ancestor_id = node_id""",
    "p6_found": _P6 + f"select target, type from one group by all having target is not null and count(*) >= {HEAVY_SHARE} * (select count(*) from one)",
    "p6_target_stats": _P6 + "select target, type, count(*) n_edges, count(distinct source) n_sources, round(avg(confidence), 6) mean_confidence from one group by all",
}
