"""Ranked symbol search: passes that are united and merged by the best score."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import dims
from graphloom.runtime import cut, portable, task_count

K1, B = 1.2, 0.75
FUZZY_BELOW = 0.4


def per_query(nodes: DataFrame, queries: list[str]) -> DataFrame:
    """Each node once for each of a few stated queries; no join."""
    return nodes.withColumn("query", F.explode(F.array(*map(F.lit, queries)))).withColumn("q", F.lower("query"))


def _has(c: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.col("q")), F.lit(False))


def _best(*scores: tuple[Column, float]) -> Column:
    return F.greatest(F.lit(0.0), *[F.when(c, F.lit(s)).otherwise(0.0) for c, s in scores])


def plain_scores(nodes: DataFrame, queries: list[str]) -> DataFrame:
    """Exact id or name 1, qualified name .9, part of the name .8, path .7, documentation .5."""
    n = per_query(nodes, queries)
    exact = (F.lower("id") == F.col("q")) | (F.lower("name") == F.col("q"))
    score = _best((F.coalesce(exact, F.lit(False)), 1.0), (_has("qualified_name"), 0.9), (_has("name"), 0.8), (_has("file_path"), 0.7), (_has("docstring"), 0.5))
    return n.withColumn("score", score).where("score > 0").select("query", "id", "name", "file_path", "type", "score")


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k best per query. Spark limits the groups of a ranking window before the shuffle."""
    w = Window.partitionBy("query").orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def terms(nodes: DataFrame) -> DataFrame:
    """Inverted index: id, term, tf. Terms are words of name, qualified name and documentation in lower case, humps split."""
    text = F.concat_ws(" ", "name", "qualified_name", "docstring")
    split = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(F.lower(split), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)
    return nodes.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, queries: list[str], k: int = 10) -> DataFrame:
    """The k best nodes per query by BM25 over the inverted index."""
    wanted = sorted({t for q in queries for t in q.lower().split()})
    sizes = index.groupBy("id").agg(F.sum("tf").alias("dl"))
    n, avgdl = sizes.agg(F.count("*"), F.avg("dl")).first()
    hits = index.where(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl or 1.0))))
    scored = hits.join(F.broadcast(df), "term").join(sizes, "id").withColumn("part", idf * tf)  # df has a row per query term
    of = F.array(*[F.struct(F.lit(q).alias("query"), F.array(*map(F.lit, q.lower().split())).alias("words")) for q in queries])
    by_query = scored.withColumn("q", F.explode(of)).where(F.array_contains("q.words", F.col("term"))).groupBy("q.query", "id").agg(F.round(F.sum("part"), 4).alias("score"))
    return top(by_query, k, F.desc("score"), F.asc("id"))


def _similarity(query: pd.Series, name: pd.Series) -> pd.Series:
    """Similarity by matching blocks; 0 where cheap upper bounds already lie below FUZZY_BELOW."""
    squeeze = lambda s: "".join(c for c in s.lower() if c.isalnum())
    least = (FUZZY_BELOW - 0.2) / 0.4
    matchers = {q: difflib.SequenceMatcher(None, squeeze(q), "") for q in query.unique()}
    out = []
    for q, n in zip(query, name):
        m = matchers[q]
        m.set_seq2(squeeze(n or ""))
        near = m.real_quick_ratio() >= least and m.quick_ratio() >= least
        out.append(0.2 + 0.4 * m.ratio() if near else 0.0)
    return pd.Series(out, dtype=float)


#: Scores of the passes that look for the whole query in a field, in full text and as a part.
FTS_SCORES = {"name": 0.8, "qualified_name": 0.78, "file_path": 0.65, "signature": 0.55, "docstring": 0.45, "tag_text": 0.45}
LIKE_SCORES = {"id": 0.7, "name": 0.68, "qualified_name": 0.62, "file_path": 0.55, "signature": 0.5, "docstring": 0.45, "tag_text": 0.45}
FTS_FIELDS = ("name", "qualified_name", "file_path", "signature", "docstring", "tag_text")
SEED = r"\b(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"
SCAN = 100


def search_filter(
    types: list[str] | None = None, paths: list[str] | None = None, exclude_paths: list[str] | None = None, languages: list[str] | None = None, layer: str | None = None, tests: bool = True, external: bool = True
) -> Column:
    """What a search may return: types, path globs, languages, layer; with or without tests and external symbols. Pushed to the scan where it can be."""
    keep = F.lit(True)
    if types:
        keep = keep & F.col("type").isin(*types)
    if not external:
        keep = keep & (F.col("type") != "external_symbol")
    if languages:
        keep = keep & F.coalesce(F.col("language_id").isin(*languages), F.lit(False))
    if not tests:
        keep = keep & (F.col("type") != "test") & ~dims.is_test_path(F.col("file_path"))
    if layer:
        keep = keep & (dims.layer(F.col("file_path")) == layer)
    for globs, wanted in ((paths, True), (exclude_paths, False)):
        if globs:
            hit = F.coalesce(F.col("file_path").rlike("|".join(dims.glob_pattern(g) for g in globs)), F.lit(False))
            keep = keep & (hit if wanted else ~hit)
    return keep


def spaced(text: Column) -> Column:
    """Words in lower case with one blank around each: a phrase is a part of it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def phrases(query: str) -> list[str]:
    """The tokens of a query, each a phrase of the words in it; any of them is a hit."""
    found = [" " + " ".join(w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()) + " " for t in query.split()]
    return list(dict.fromkeys(p for p in found if p.strip()))


def full_text(nodes: DataFrame, queries: list[str], survivors: int = SCAN) -> DataFrame:
    """query and id of the nodes that contain a token of a query, the best by BM25 over all fields; ties by id."""
    flat = nodes.select("id", spaced(F.concat_ws(" ", *FTS_FIELDS)).alias("t"))
    flat = flat.withColumn("dl", F.size(F.split(F.trim("t"), " ")))
    n, avgdl = flat.agg(F.count("*"), F.avg("dl")).first()
    asked = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(p).alias("phrase")) for q in queries for p in phrases(q)] or [F.struct(F.lit("").alias("query"), F.lit("\0").alias("phrase"))])
    hit = flat.select("id", "t", "dl", F.inline(asked)).where(F.contains("t", F.col("phrase")))
    # neighbouring phrases share a blank, so each is counted without the one behind it
    tf = (F.length("t") - F.length(F.replace(F.col("t"), F.expr("rtrim(phrase)"), F.lit("")))) / F.length(F.expr("rtrim(phrase)"))
    hit = hit.select("query", "phrase", "id", "dl", tf.alias("tf"))
    df = hit.groupBy("query", "phrase").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl or 1.0))))
    scored = hit.join(F.broadcast(df), ["query", "phrase"]).groupBy("query", "id").agg(F.round(F.sum(part), 6).alias("bm"))  # df has a row per token of a query
    return top(scored, survivors, F.desc("bm"), F.asc("id")).select("query", "id")


def multi_pass(nodes: DataFrame, queries: list[str], limit: int = 20, offset: int = 0, min_score: float = 0.2, fuzzy: bool = True, keep: Column | None = None) -> DataFrame:
    """Passes united by the best score: names within the query .98, id 1, qualified name .95, name .9, full text, parts of texts, and similar names.

    Full text takes nodes with any token of the query, of these the best by BM25; their score is
    that of the field that contains the whole query, else .6. Parts are literal. Of each of these
    two passes max(limit + offset, 100) nodes survive, of the latter in order of names. Only if the
    best score of a query is below FUZZY_BELOW its similarity to all distinct names is computed.

    Order: exactness, tests and externals last (unless the query is about tests), framework entries
    and production code first, score, shorter path, initialisers and tests last, id. `keep` is a
    search_filter(). An empty query gives nothing.

    Returns query, rank, id, score, sources (of exact passes), and per query total, truncated and
    ambiguous: several paths for an exact name, or the best three scores within .05.
    """
    scan = max(limit + offset, SCAN)
    nodes = nodes.where(keep) if keep is not None else nodes
    nodes = nodes.withColumn("tag_text", F.concat_ws(" ", "tags"))
    queries = [q for q in dict.fromkeys(q.strip() for q in queries) if q]
    n = per_query(nodes, queries or ["\0"])
    same = lambda c: F.coalesce(F.col(c) == F.col("query"), F.lit(False))
    seeds = {q: [w for w in dict.fromkeys(re.findall(SEED, q)) if len(w) >= 4] for q in queries}
    seed = F.lit(False)
    for q, names in seeds.items():
        if names:
            seed = seed | ((F.col("query") == q) & F.coalesce(F.col("name").isin(names), F.lit(False)))
    exact = {"exact_symbol_id": (same("id"), 1.0), "exact_qualified_name": (same("qualified_name"), 0.95), "exact_name": (same("name"), 0.9), "seed_name": (seed, 0.98)}
    sources = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, (c, _) in exact.items()]))
    columns = ["query", "id", "score", "sources"]
    direct = n.withColumn("score", _best(*exact.values())).withColumn("sources", sources).where("score > 0").select(*columns)
    none = F.array().cast("array<string>").alias("sources")
    within = F.greatest(*[F.when(_has(c), F.lit(v)).otherwise(0.0) for c, v in FTS_SCORES.items()])
    text = n.join(full_text(nodes, queries, scan), ["query", "id"]).select("query", "id", F.when(within > 0, within).otherwise(0.6).alias("score"), none)
    part = n.withColumn("score", _best(*[(_has(c), v) for c, v in LIKE_SCORES.items()])).where("score > 0")
    part = top(part, scan, F.col("name").asc_nulls_first(), F.col("id")).select("query", "id", "score", none)
    hits = direct.unionByName(text).unionByName(part)
    if fuzzy and queries:
        best = {r["query"]: r["best"] for r in hits.groupBy("query").agg(F.max("score").alias("best")).collect()}  # a row per query
        weak = [q for q in queries if best.get(q, 0.0) < FUZZY_BELOW]
        if weak:
            ratio = F.pandas_udf(portable(_similarity, "series"), "double")
            names = nodes.select("name").where("name is not null").distinct().repartition(task_count(nodes.sparkSession), "name").withColumn("query", F.explode(F.array(*map(F.lit, weak)))).withColumn("score", F.round(ratio("query", "name"), 4)).where(F.col("score") >= FUZZY_BELOW)
            hits = hits.unionByName(nodes.join(cut(names), "name").select("query", "id", "score", none))
    merged = hits.where(F.col("score") >= min_score).groupBy("query", "id").agg(F.max("score").alias("score"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"))  # a row per pass
    merged = merged.join(nodes.select("id", "name", "type", "file_path", "tags"), "id")
    path, has = F.coalesce("file_path", F.lit("")), lambda s: F.array_contains("sources", s)
    test, external = (F.col("type") == "test") | dims.is_test_path(F.col("file_path")), F.col("type") == "external_symbol"
    about_tests = F.col("query").isin([q for q in queries if dims.has_test_intent(q)] or [""])
    first = F.when(has("exact_symbol_id"), 0).when(has("exact_qualified_name"), 1).when(has("exact_name"), 2).when(has("seed_name"), 3).otherwise(99)
    init = F.coalesce(F.col("name") == "__init__", F.lit(False)) | F.endswith(path, F.lit("__init__.py"))
    production = dims.is_production_path(F.col("file_path")) & ~test & ~external
    order = [first, (test & ~about_tests).cast("int"), external.cast("int"), (~dims.is_entry(F.col("type"), F.col("tags"), F.col("name"))).cast("int"), (~production).cast("int"), F.desc("score"), F.length(path), init.cast("int"), test.cast("int"), F.col("id")]
    w, whole = Window.partitionBy("query").orderBy(*order), Window.partitionBy("query")  # at most a few hundred rows a query
    ranked = merged.withColumn("rank", F.row_number().over(w)).withColumn("by_score", F.row_number().over(whole.orderBy(F.desc("score"), "id"))).withColumn("total", F.count("*").over(whole).cast("int"))
    spread = F.max("score").over(whole) - F.min(F.when(F.col("by_score") <= 3, F.col("score"))).over(whole)
    paths = F.size(F.collect_set(F.when(has("exact_name"), path)).over(whole))
    ranked = ranked.withColumn("ambiguous", (paths > 1) | ((F.col("total") > 1) & (F.round(spread, 6) < 0.05)))
    page = ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return page.select("query", "rank", "id", "score", F.array_join(F.array_sort("sources"), ",").alias("sources"), "total", (F.col("total") > offset + limit).alias("truncated"), "ambiguous")


def fallback(nodes: DataFrame, edges: DataFrame, query: str, k: int = 20, near: int = 5) -> DataFrame:
    """What to offer where nothing answers to a query: symbols whose name or id contains it, symbols of the same file, and callers and callees of the best; kind, at, id."""
    q = query.split("::")[-1].split(".")[-1].lower()
    partial = nodes.where(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("id"), F.lit(query.lower()))).select("id", F.length("name").alias("n")).orderBy("n", "id").limit(k)
    file = query.split("::")[0]
    siblings = nodes.where((F.col("file_path") == file) & ~F.col("type").isin("file", "module")).orderBy("line_start", "id").limit(k).select("id")
    best = cut(partial.limit(1).select(F.col("id").alias("best")))
    calls = edges.where("type = 'calls'")
    around = lambda a, b, kind: calls.join(F.broadcast(best), F.col(a) == F.col("best")).groupBy(F.col(b).alias("id")).agg(F.max("confidence").alias("c")).orderBy(F.desc("c"), "id").limit(near).select(F.lit(kind).alias("kind"), "id")  # noqa: E731  (one row)
    rows = partial.select(F.lit("partial").alias("kind"), "id").unionByName(siblings.select(F.lit("sibling").alias("kind"), "id")).unionByName(around("target", "source", "caller")).unionByName(around("source", "target", "callee"))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).select("kind", "at", "id")


# Words and relevance

#: Words that say nothing in a task.
STOPWORDS = "a an the and or of to in for on with is are be this that it as at by from how what where which when do does add fix make use using should can into not".split()


def tokenize(text: Column) -> Column:
    """Lower-case words of more than two characters without stopwords, in order of first occurrence."""
    return F.array_except(F.filter(F.split(F.lower(text), r"[^a-zA-Z0-9_]+"), lambda t: F.length(t) > 2), F.array(*map(F.lit, STOPWORDS)))


def decompose(name: Column) -> Column:
    """Parts of a name at humps, underscores and digits, in lower case, each once."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"[^a-z]+"), lambda t: t != ""))


def token_estimate(text: Column) -> Column:
    """About how many tokens a text has: a quarter of its characters, at least one; none if empty."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.floor(F.length(text) / 4), F.lit(1)))


def task_words(task: str) -> list[str]:
    return [w for w in dict.fromkeys(re.split(r"[^a-zA-Z0-9_]+", task.lower())) if len(w) > 2 and w not in STOPWORDS]


def relevance_parts(task: str) -> tuple[Column, Column]:
    """Score and number of matches of a node for a task.

    Per word: name .95 (counts twice), prefix either way .85, part .8; part of the decomposed name
    .82; name of the file .85 (twice), component of the path .78, part of it .7; qualified name
    .85; documentation .6; module .7. Entries of frameworks have .72 at least and .1 more. Without
    test intent tests are capped at .55, other symbols of test files at .65. Production code has
    .03 more, each match .02; without a match the score is 0.
    """
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    name, path, parts = lower("name"), lower("file_path"), decompose(F.coalesce("name", F.lit("")))
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    pieces = F.split(path, r"[/.\s]+")
    best, matches = F.lit(0.0), F.lit(0)
    for w in task_words(task):
        t = F.lit(w)
        groups = [
            [(name == t, 0.95, 2), ((name != "") & (F.startswith(name, t) | F.startswith(t, name)), 0.85, 1), (F.contains(name, t), 0.8, 1)], [(F.array_contains(parts, w), 0.82, 1)],
            [(base == t, 0.85, 2), (F.array_contains(pieces, w), 0.78, 1), (F.contains(path, t), 0.7, 1)], [(F.contains(lower("qualified_name"), t), 0.85, 1)], [(F.contains(lower("docstring"), t), 0.6, 1)], [(F.contains(lower("module"), t), 0.7, 1)],
        ]
        for g in groups:
            score, count = F.lit(0.0), F.lit(0)
            for cond, v, k in reversed(g):
                score, count = F.when(cond, v).otherwise(score), F.when(cond, k).otherwise(count)
            best, matches = F.greatest(best, score), matches + count
    entry = dims.is_entry(F.col("type"), F.col("tags"), F.col("name"))
    best = F.when(entry, F.least(F.greatest(best, F.lit(0.72)) + 0.1, F.lit(1.0))).otherwise(best)
    if not dims.has_test_intent(task):
        best = F.when(F.col("type") == "test", F.least(best, F.lit(0.55))).when(dims.is_test_path(F.col("file_path")), F.least(best, F.lit(0.65))).otherwise(best)
    best = F.when(dims.is_production_path(F.col("file_path")), F.least(best + 0.03, F.lit(1.0))).otherwise(best)
    return F.when(matches == 0, 0.0).otherwise(F.round(F.least(best + matches * 0.02, F.lit(1.0)) + 1e-9, 4)), matches


def relevance(nodes: DataFrame, task: str, k: int = 20) -> DataFrame:
    """The k nodes most relevant to a task; ties by id. See relevance_parts()."""
    score, matches = relevance_parts(task)
    ranked = nodes.select("id", "name", score.alias("score"), matches.alias("matches")).where("score > 0")
    return ranked.orderBy(F.desc("score"), "id").limit(k)
