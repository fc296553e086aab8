"""Queries of the reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.functions.intents import INTENTS, TEST_WORDS, WRITE_WORDS, intent, pattern
from graphloom.functions.keys import clean_path
from graphloom.operators import reports
from graphloom.operators.hierarchy import descendants, hierarchy
from graphloom.plans.general import _P5, _P5_PAIRS, _contains
from graphloom.plans.graph import N, NE, _COVTEST, _SQL_PATH, _TEST, _matches, edges, nodes
from graphloom.runtime import table


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of each path in the last snapshot that has it."""
    f = table(spark, d, "fingerprints").select("repo_id", clean_path(F.col("file_path")).alias("file_path"), "snapshot_no", "loaded_at", F.lower("sha256").alias("sha256"), "mtime", "size").where("file_path is not null")
    w = Window.partitionBy("file_path").orderBy(F.col("snapshot_no").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), F.col("mtime").desc_nulls_last(), F.col("size").desc_nulls_last())
    return f.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "snapshot_no", "loaded_at")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(_contains(spark, d), with_paths=True, with_cycles=True))


def test_file_detection(spark: SparkSession, d: str) -> DataFrame:
    """The delivered files, and each of them once more in a folder of tests."""
    f = table(spark, d, "source_files").select("file_path", "repo_id")
    return reports.test_files(f.unionByName(f.withColumn("file_path", F.regexp_replace("file_path", "^([^/]*)/", "$1/tests/"))))


QUERIES = {
    "p5_descendants": p5_descendants,
    "rank_symbols_in_file": lambda s, d: reports.rank_symbols(nodes(s, d)),
    "file_roles": lambda s, d: reports.file_roles(nodes(s, d)),
    "enrichment_prepare": lambda s, d: reports.enrichment_prepare(nodes(s, d), edges(s, d)),
    "scan_overview": lambda s, d: reports.scan_overview(nodes(s, d), edges(s, d)),
    "test_file_detection": test_file_detection,
    "index_status": lambda s, d: reports.index_status(table(s, d, "source_files"), _stored(s, d)),
    "stat_prefilter": lambda s, d: reports.stat_prefilter(table(s, d, "source_files"), _stored(s, d)),
    "freshness": lambda s, d: reports.freshness(table(s, d, "source_files"), _stored(s, d)),
    "task_intents": lambda s, d: table(s, d, "documents").where("text is not null").groupBy("source", intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n")),
    "visibility": lambda s, d: nodes(s, d).where("name is not null").groupBy(dims.visibility(F.col("name")).alias("visibility"), "type").agg(F.count("*").alias("n")),
}
_EXT = " ".join(f"when '{x}' then '{lang}'" for x, lang in dims.EXTENSIONS.items())
_LAYER = "case " + " ".join(f"when {_matches('lower(file_path)', p)} then '{n}'" for n, p in dims.LAYERS) + " else 'unknown' end"
_STORED_SQL = f"""st as (select repo_id, {_SQL_PATH("file_path")} file_path, lower(sha256) sha256, mtime, size from fingerprints where {_SQL_PATH("file_path")} is not null
  qualify row_number() over (partition by {_SQL_PATH("file_path")} order by snapshot_no desc nulls last, loaded_at desc nulls last, mtime desc nulls last, size desc nulls last) = 1)"""
_CALLS = "select {h} id, string_agg(other, ',' order by rn) {n} from (select *, row_number() over (partition by {h} order by c desc, other) rn from (select {h}, {t} other, max(confidence) c from e where type = 'calls' group by all)) where rn <= 5 group by {h}"
ORACLE = {
    "p5_descendants": _P5 + _P5_PAIRS + "select * from pairs",
    "rank_symbols_in_file": N
    + """select file_path, rank::int as rank, id, score from (select *, row_number() over (partition by file_path order by score desc, id) rank from (select file_path, id, (case when coalesce(length(trim(docstring)), 0) > 0 then 10 else 0 end + 2 * len(tags)
  + case when starts_with(name, '_') then 0 else 3 end + case when coalesce(length(trim(signature)), 0) > 0 then 2 else 0 end)::int score from n where type not in ('file', 'module', 'external_symbol') and file_path is not null)) where rank <= 8""",
    "file_roles": N
    + f"""select file_path, case when {_TEST()} then 'test' when r then 'api' when m then 'model' when c then 'config' when s then 'storage' when n_symbols = 0 then 'empty' else {_LAYER} end as role, n_symbols from (
  select file_path, bool_or(list_contains(tags, 'route')) r, bool_or(list_contains(tags, 'model')) m, bool_or(list_contains(tags, 'config')) c, bool_or(list_contains(tags, 'store')) s, count_if(type not in ('file', 'module'))::bigint n_symbols from n where file_path is not null group by file_path)""",
    "enrichment_prepare": NE
    + f"""select s.id, file_path, at_::int as at, callers, callees from (select id, file_path, row_number() over (partition by file_path order by line_start nulls first, id) at_ from n where type in ('function', 'method', 'class') and file_path is not null) s
  left join ({_CALLS.format(h="target", t="source", n="callers")}) using (id) left join ({_CALLS.format(h="source", t="target", n="callees")}) using (id) where at_ <= 20""",
    "scan_overview": NE
    + f"""select * from (select file_path, sum(d)::bigint degree from n join (select id, count(*) d from (select source id from e union all select target from e) group by id) using (id) where file_path is not null group by file_path order by degree desc, file_path limit 15)
  where not {_TEST()} order by degree desc, file_path limit 5""",
    "test_file_detection": f"select repo_id, case lower(regexp_extract(file_path, '[.]([^./]+)$', 1)) {_EXT} end as language, count(*) n_files, min(file_path) sample from (select distinct file_path, repo_id from (select file_path, repo_id from source_files union all select regexp_replace(file_path, '^([^/]*)/', '\\1/tests/'), repo_id from source_files) where {_COVTEST()}) group by all",
    "index_status": f"""with {_STORED_SQL}, f as (select file_path, repo_id, content from source_files qualify row_number() over (partition by file_path order by loaded_at desc nulls last) = 1)
select coalesce(f.repo_id, st.repo_id) repo_id, case when st.file_path is null then 'added' when f.file_path is null then 'deleted' when sha256(content) = st.sha256 then 'unchanged' else 'changed' end state, count(*) n_files from f full join st on f.file_path = st.file_path group by all""",
    "stat_prefilter": f"""with {_STORED_SQL}, f as (select file_path, max(modification_time) t, max(length) length, max(repo_id) repo_id from source_files group by file_path)
select f.repo_id, case when abs(epoch_us(t) / 1e6 - mtime) < 0.001 and length = size then 'same_stat' else 'must_hash' end state, count(*) n_files from f left join st on f.file_path = st.file_path group by all""",
    "freshness": f"""with {_STORED_SQL}, f as (select file_path, max(modification_time) t, max(repo_id) repo_id from source_files group by file_path)
select f.repo_id, case when st.file_path is null then 'pending' when t is null or mtime is null then 'unknown' when epoch_us(t) / 1e6 - mtime > 1 then 'edited_recently' else 'fresh' end state, count(*) n_files from f left join st on f.file_path = st.file_path group by all""",
    "task_intents": f"""select source, case when {_matches("lower(text)", pattern(TEST_WORDS))} and {_matches("lower(text)", pattern(WRITE_WORDS))} then 'write_tests' {" ".join(f"when {_matches('lower(text)', pattern(w))} then '{n}'" for n, w in INTENTS)}
  else 'understand_code' end intent, count(*) n from documents where text is not null group by all""",
    "visibility": N + "select case when starts_with(name, '__') then 'private' when starts_with(name, '_') then 'protected' else 'public' end visibility, type, count(*) n from n where name is not null group by all",
}
