"""From source files to the graph: extraction per file, resolution by joins, structural and test edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from graphloom.functions import dims
from graphloom.ingest.extract import extract, fingerprint, package_of
from graphloom.ingest.lexing import decode, language_of
from graphloom.ingest.resolve import resolve, resolve_imports
from graphloom.runtime import cut, portable, spread

FACTS = (
    "record string, file_path string, repo_id string, id string, type string, name string, qualified_name string, line_start int, line_end int, signature string, docstring string, tags array<string>, "
    "language_id string, kind string, qualifier string, module string, package string, receiver string, via string"
)
EDGE = "source string, target string, type string, confidence double, resolution string"


def _arrow(df: DataFrame, rows, schema: str, *columns: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(parsed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [r for args in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns)) for r in rows(*args)]
            cols = list(zip(*made)) if made else [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

    return df.select(*columns).mapInArrow(portable(work), schema)


def deliveries(files: DataFrame, *more: str) -> DataFrame:
    """Delivered files outside of excluded folders, where they lie or in enough tasks for parsing: file_path, repo_id, arrival, digest, content and further columns."""
    kept = files.where(F.col("file_path").isNotNull() & ~dims.is_excluded(F.col("file_path")))
    return spread(kept.select("file_path", "repo_id", F.col("loaded_at").alias("arrival"), F.xxhash64("content").alias("digest"), "content", *more))


def _facts(path: str, repo: str | None, arrival, digest: int, content: bytes | None) -> Iterator[tuple]:
    lang = language_of(path)
    symbols, links = extract(path, content)
    package = package_of(path, decode(content), lang)
    for s in symbols:
        yield "node", path, repo, s.id, s.type, s.name, s.qualified_name, s.line_start, s.line_end, s.signature, s.docstring, s.tags, lang, None, None, None, package, None, None, arrival, digest
    for x in links:
        yield "link", path, repo, x.source, None, x.name, None, x.line, None, None, None, None, lang, x.kind, x.qualifier, x.module, package, x.receiver, x.via, arrival, digest


def parsed(files: DataFrame, *more: str) -> DataFrame:
    """Nodes and raw references of every delivery, parsed where it lies, cut. Each row has also `arrival` and `digest` of its delivery and the columns named."""
    d = deliveries(files, *more)
    kinds = dict(d.dtypes)
    schema = ", ".join([FACTS, f"arrival {kinds['arrival']}, digest bigint", *[f"{c} {kinds[c]}" for c in more]])
    rows = lambda path, repo, arrival, digest, content, *rest: [(*r, *rest) for r in _facts(path, repo, arrival, digest, content)]
    return cut(_arrow(d, rows, schema, "file_path", "repo_id", "arrival", "digest", "content", *more))


def newest(raw: DataFrame) -> DataFrame:
    """The facts that count of parsed() deliveries, cut: of several of one path those of the last to arrive, at a tie of the greatest digest."""
    again = raw.where("record = 'node' and type = 'file'").groupBy("file_path").agg(F.max(F.struct("arrival", "digest")).alias("w"), F.count("*").alias("n")).where("n > 1").drop("n")
    counts = F.col("w").isNull() | (F.col("arrival").eqNullSafe(F.col("w.arrival")) & (F.col("digest") == F.col("w.digest")))
    return cut(raw.join(again, "file_path", "left").where(counts).select(*[c.split()[0] for c in FACTS.split(", ")]))


def facts(files: DataFrame) -> DataFrame:
    """Nodes and raw references of all files in one pass, cut.

    Every delivery is parsed where it lies. Of several of one path that which arrived last counts
    (at a tie the greatest digest); the facts of the others are taken out afterwards, so contents
    are never shuffled to find it.
    """
    return newest(parsed(files))


def structural_edges(nodes: DataFrame) -> DataFrame:
    """A file contains its functions and classes, a class its methods; each is defined in its file."""
    inside = F.regexp_extract("id", r"::(.*)$", 1)
    parent = F.when(F.contains(inside, F.lit(".")), F.regexp_extract("id", r"^(.*)\.[^.]+$", 1)).otherwise(F.col("file_path"))
    edge = lambda a, b, t: F.struct(a.alias("source"), b.alias("target"), F.lit(t).alias("type"))
    both = nodes.where("type <> 'file'").select(F.inline(F.array(edge(parent, F.col("id"), "contains"), edge(F.col("id"), F.col("file_path"), "defined_in"))))
    return both.select("source", "target", "type", F.lit(1.0).alias("confidence"), F.lit("exact_ast_match").alias("resolution"))


#: How each framework's injected types and elements are resolved: in the repository, and else.
_BY_NAME = {"spring": ("depends_on", "spring_di_constructor", 0.90), "nest": ("depends_on", "nestjs_injection_resolved", 0.88), "aspnet": ("depends_on", "aspnetcore_di_constructor", 0.88), "django": ("references", "django_view_heuristic", 0.65), "react": ("references", "jsx_component_resolved", 0.88)}


def framework_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Injected types and elements to the only class, or for elements component, of that name in the repository; an ambiguous bean is a candidate."""
    repo = F.coalesce("repo_id", F.lit(""))
    by_name = nodes.where("type in ('class', 'function') and name rlike '^[A-Z]'").groupBy(repo.alias("repo_id"), "name").agg(F.min("id").alias("target"), F.count_distinct("id").alias("n"))
    at = links.where("kind in ('depends', 'element')").select(F.col("id").alias("source"), repo.alias("repo_id"), "name", "via").join(by_name, ["repo_id", "name"])
    kind, resolution, confidence = (F.element_at(F.create_map(*[F.lit(x) for k, v in _BY_NAME.items() for x in (k, v[i])]), F.col("via")) for i in range(3))
    bean = (F.col("n") > 1) & (F.col("via") == "spring")
    return at.select("source", "target", kind.alias("type"), F.when(bean, 0.45).otherwise(confidence).alias("confidence"), F.when(bean, "spring_bean_candidate").otherwise(resolution).alias("resolution"))


def route_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Routes to their handlers, where the handler is a symbol of the same file."""
    local = nodes.where("type in ('function', 'method')").select("file_path", F.col("name").alias("handler"), F.col("id").alias("target"))
    r = links.where("kind = 'route'").select("file_path", F.concat("file_path", F.lit("::route "), "name").alias("source"), F.element_at(F.split("qualifier", r"\."), -1).alias("handler"))
    return r.join(local, ["file_path", "handler"]).groupBy("source").agg(F.min("target").alias("target")).select("source", "target", F.lit("routes_to").alias("type"), F.lit(0.92).alias("confidence"), F.lit("framework_route_resolved").alias("resolution"))


def test_edges(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """tested_by edges: a test calls the symbol .90, its name begins with the symbol's .65, or its file is named after the symbol's .55; the strongest counts."""
    tests = nodes.where("type = 'test'").select(F.col("id").alias("test"), "repo_id", "name")
    by_call = calls.where("type = 'calls'").join(tests.select(F.col("test").alias("source")), "source").where(~F.col("target").rlike("^(external|unresolved):")).select(F.col("target").alias("s"), F.col("source").alias("t"), F.lit(0.90).alias("c"), F.lit("direct_test_call").alias("r"))
    parts = tests.select("test", "repo_id", F.split(F.regexp_replace("name", "^test_", ""), "_").alias("p")).select("test", "repo_id", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    named = parts.select("test", "repo_id", "k", F.array_join(F.slice("p", F.lit(1), F.col("k")), "_").alias("name")).join(nodes.where("type in ('function', 'method')").select("repo_id", "name", "id"), ["repo_id", "name"])
    w = Window.partitionBy("test").orderBy(F.desc("k"), "id")
    by_name = named.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("id").alias("s"), F.col("test").alias("t"), F.lit(0.65).alias("c"), F.lit("test_name_heuristic").alias("r"))
    stem = F.regexp_extract("file_path", r"([^/]+)\.\w+$", 1)
    of_file = nodes.where("type = 'test'").select(F.col("id").alias("t"), "repo_id", F.regexp_extract(stem, r"^test_(.+)$|^(.+)_test$", 1).alias("a"), F.regexp_extract(stem, r"^(.+)_test$", 1).alias("z"))
    of_file = of_file.select("t", "repo_id", F.when(F.col("a") != "", F.col("a")).when(F.col("z") != "", F.col("z")).alias("stem")).where("stem is not null")
    modules = nodes.where("type in ('function', 'method', 'class')").select(F.col("id").alias("s"), "repo_id", stem.alias("stem"))
    by_file = of_file.join(modules, ["repo_id", "stem"]).select("s", "t", F.lit(0.55).alias("c"), F.lit("test_file_heuristic").alias("r"))
    best = by_call.unionByName(by_name).unionByName(by_file).groupBy("s", "t").agg(F.max(F.struct("c", "r")).alias("b"))
    return best.select(F.col("s").alias("source"), F.col("t").alias("target"), F.lit("tested_by").alias("type"), F.col("b.c").alias("confidence"), F.col("b.r").alias("resolution"))


def graph_of(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of facts; all that follows parsing, and all of it joins."""
    columns = ["id", "type", "name", "qualified_name", "file_path", "repo_id", "language_id", "line_start", "line_end", "signature", "docstring", "tags"]
    declared = f.where("record = 'node'").groupBy("id").agg(F.min(F.struct("line_start", *[c for c in columns if c not in ("id", "line_start")], "package")).alias("n"))  # of several of one id the first in the file
    full = cut(declared.select("id", *[f"n.{c}" for c in columns[1:]], "n.package"))
    nodes, links = full.select(*columns), f.where("record = 'link'")
    calls = cut(resolve(links, full).drop("rung"))
    edges = calls
    for more in (structural_edges(nodes), resolve_imports(links, nodes), route_edges(links, nodes), framework_edges(links, nodes), test_edges(nodes, calls)):
        edges = edges.unionByName(more)
    routes = links.where("kind = 'route'").groupBy(F.concat("file_path", F.lit("::route "), "name").alias("id")).agg(F.min(F.struct("line_start", "name", "file_path", "repo_id", "language_id")).alias("r"))
    routes = routes.select(
        "id", F.lit("route").alias("type"), "r.name", F.col("r.name").alias("qualified_name"), "r.file_path", "r.repo_id", "r.language_id", "r.line_start", F.col("r.line_start").alias("line_end"),
        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"), F.array(F.lit("route")).alias("tags"),
    )
    best = edges.groupBy("source", "target", "type").agg(F.max(F.struct("confidence", "resolution")).alias("b")).select("source", "target", "type", "b.confidence", "b.resolution")
    return nodes.unionByName(routes), best


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of source files.

    The files are parsed once, in as many tasks as the cluster has use for; everything after is
    joins. Of equal edges (source, target, type) the one of greatest confidence counts. Files of
    unknown languages, empty and broken ones give at least their own node.
    """
    return graph_of(facts(files))


def patch_graph(nodes: DataFrame, edges: DataFrame, stored: DataFrame, files: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One incremental step that ends where a full build would: nodes, edges and facts.

    `stored` are the facts() of the graph. Only the files that came are parsed. References are
    resolved within a repository, so those of the repositories that the step touches are resolved
    again, against stored and new symbols alike; unchanged files in them may now mean a symbol that
    came, or no longer one that went. Other repositories keep their nodes and edges as they are.
    """
    return patch_facts(nodes, edges, stored, facts(files), removed)


def patch_facts(nodes: DataFrame, edges: DataFrame, stored: DataFrame, new: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """patch_graph() with the facts() of the files that came."""
    again = new.select("file_path").unionByName(removed.select("file_path")).distinct()
    repo = F.coalesce("repo_id", F.lit("")).alias("repo")
    touched = cut(new.select(repo).unionByName(stored.join(again, "file_path", "left_semi").select(repo)).distinct())
    kept = stored.join(again, "file_path", "left_anti").select(*new.columns)
    here = lambda df, how: df.join(touched, F.coalesce(df["repo_id"], F.lit("")) == touched["repo"], how)
    n, e = graph_of(cut(here(kept, "left_semi").unionByName(new)))
    gone = here(nodes, "left_semi")
    # by files too, for a source need not be a node: of a broken file the methods may be found and not their class
    others = edges.join(gone.select(F.col("id").alias("source")), "source", "left_anti").withColumn("file_path", F.substring_index("source", "::", 1))
    others = others.join(gone.where("type = 'file'").select("file_path"), "file_path", "left_anti").select(*e.columns)
    return here(nodes, "left_anti").select(*n.columns).unionByName(n), others.unionByName(e), kept.unionByName(new)


def fingerprints(files: DataFrame) -> DataFrame:
    """file_path, sha256 and the four structural hashes of each file, of the delivery that arrived last."""
    hashes = ["sha256", "structural_hash", "symbols_hash", "imports_hash", "calls_hash"]
    d = deliveries(files)
    schema = f"file_path string, arrival {dict(d.dtypes)['arrival']}, digest bigint, " + ", ".join(f"{h} string" for h in hashes)
    each = _arrow(d, lambda p, a, g, c: [(p, a, g, *fingerprint(p, c))], schema, "file_path", "arrival", "digest", "content")
    last = each.groupBy("file_path").agg(F.max(F.struct("arrival", "digest", *hashes)).alias("r"))
    return last.select("file_path", *[f"r.{h}" for h in hashes])
