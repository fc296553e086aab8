"""Queries that read source files, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.ingest.build import build_graph, facts, fingerprints, graph_of, newest, parsed, patch_facts
from graphloom.runtime import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files")


def ingest_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(_files(spark, sf_dir)).where("record = 'node'").groupBy("language_id", "type").agg(F.count_distinct("id").alias("n"))


def ingest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_graph(_files(spark, sf_dir))[1].groupBy("type", "resolution").agg(F.count("*").alias("n"))


def n_differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, each as often as it does: both are computed once."""
    both = a.withColumn("n_differing", F.lit(1)).unionByName(b.withColumn("n_differing", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("n_differing").alias("n_differing")).agg(F.coalesce(F.sum(F.abs("n_differing")), F.lit(0).cast("bigint")).alias("n_differing"))


def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last index run of each repository as one incremental step: rows in which the patched graph differs from a full build, none.

    Every delivery is parsed once, and its facts serve the stored graph or the step, and the full build.
    """
    files = _files(spark, sf_dir)
    last = files.groupBy(F.col("repo_id").alias("of")).agg(F.max("batch_no").alias("last"))
    raw = parsed(files, "batch_no")
    marked = raw.join(last, F.col("repo_id").eqNullSafe(F.col("of")), "left")
    stored, new = newest(marked.where("batch_no < last")), newest(marked.where("batch_no >= last or last is null or batch_no is null"))
    patched = patch_facts(*graph_of(stored), stored, new, new.select("file_path").limit(0))
    full = graph_of(newest(raw))
    of = lambda k, name: n_differing(patched[k], full[k]).select(F.lit(name).alias("of"), "n_differing")
    return of(0, "nodes").unionByName(of(1, "edges"))


def structural_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_files(spark, sf_dir))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha256 of each path's content, all in the JVM."""
    f = _files(spark, sf_dir).groupBy("file_path").agg(F.max(F.struct("loaded_at", "content")).alias("f"))
    return f.select("file_path", F.sha2("f.content", 256).alias("sha256"), F.octet_length("f.content").cast("long").alias("n_bytes"))


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of supported languages outside of excluded folders, per repository and language."""
    f = _files(spark, sf_dir).select("file_path", "repo_id").distinct().withColumn("language", dims.language(F.col("file_path")))
    return f.where(F.col("language").isNotNull() & ~dims.is_excluded(F.col("file_path"))).groupBy("repo_id", "language").agg(F.count("*").alias("n_files"))


QUERIES = {f.__name__: f for f in (ingest_symbols, ingest_graph, incremental_equals_full, structural_fingerprints, content_hashes, scanned_files)}
_EXT = " ".join(f"when '{x}' then '{lang}'" for x, lang in dims.EXTENSIONS.items())
ORACLE = {
    "incremental_equals_full": "select 'nodes' as of, 0::bigint n_differing union all select 'edges', 0",
    "content_hashes": "select file_path, sha256(content) sha256, octet_length(content)::bigint n_bytes from source_files qualify row_number() over (partition by file_path order by loaded_at desc nulls last) = 1",
    "scanned_files": f"""select repo_id, language, count(*) n_files from (select distinct file_path, repo_id, case lower(regexp_extract(file_path, '[.]([^./]+)$', 1)) {_EXT} end as language from source_files)
  where language is not null and not regexp_matches(file_path, '(^|/)({"|".join(w.replace(".", "[.]") for w in dims.EXCLUDED_FOLDERS)})/') group by all""",
}
