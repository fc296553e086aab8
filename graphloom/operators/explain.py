"""What a symbol or file is, in words and numbers: summaries, signals, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import dims

#: First word of a name and what it says.
VERBS = {
    "get": "Retrieves", "fetch": "Fetches", "set": "Sets", "is": "Checks whether", "has": "Checks whether", "handle": "Handles", "process": "Processes", "compute": "Computes", "build": "Builds", "create": "Creates",
    "delete": "Deletes", "remove": "Removes", "update": "Updates", "parse": "Parses", "validate": "Validates", "save": "Saves", "load": "Loads", "render": "Renders", "resolve": "Resolves", "format": "Formats",
    "convert": "Converts", "transform": "Transforms", "find": "Finds", "search": "Searches", "check": "Checks", "run": "Runs", "start": "Starts", "stop": "Stops", "init": "Initializes", "setup": "Sets up",
    "teardown": "Tears down", "register": "Registers", "apply": "Applies", "generate": "Generates", "calculate": "Calculates", "read": "Reads", "write": "Writes", "send": "Sends", "receive": "Receives",
}
#: Parts of lower-case text that show what an implementation uses.
SIGNALS = {
    "uses_json": ("json", "serialize", "deserialize", "marshal", "unmarshal"),
    "uses_database": ("sql", "query", "execute", "commit", "rollback", "cursor", "fetchone", "fetchall", "fetchmany", "prisma", "sqlite", "sqlalchemy", "psycopg", "mysql", "orm", "repository", "migrate"),
    "uses_io": ("open(", "read(", "write(", "readfile", "writefile", "fopen", "fclose", "mkdir", "rmdir", "listdir", "scandir", "readlines", "writelines"),
    "uses_network": ("http", "https", "request", "fetch", "axios", "curl", "url", "socket", "tcp", "getrequest", "postrequest", "apiclient", "restclient", "httpx"),
    "has_error_handling": ("try", "except", "catch", "raise ", "throw "),
    "uses_async": ("async", "await", "coroutine", "asyncio", "future", "promise"),
}
#: Codes of reasons, by a word of the reason; the first that occurs counts.
REASON_CODES = (
    ("security", "sensitive_path"), ("auth", "sensitive_path"), ("credential", "sensitive_path"), ("route", "public_api"), ("api", "public_api"), ("state", "state_mutation"), ("write", "state_mutation"), ("persist", "state_mutation"),
    ("caller", "upstream_caller"), ("callee", "downstream_call"), ("test", "missing_tests"), ("isolated", "isolated_symbol"),
)


def reason_code(reason: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for word, code in REASON_CODES:
        out = out.when(F.contains(F.lower(reason), F.lit(word)), code)
    return F.coalesce(out, F.lit("unknown"))


def first_sentence(doc: Column) -> Column:
    """Up to the first line end or full stop before a blank, at most 160 characters; null if nothing is there."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    s = F.substring(trim(F.regexp_extract(trim(doc), r"^((?:[^.\n]|\.(?![ \n]|$))*\.?)", 1)), 1, 160)
    return F.when(s != "", s)


def phrase(name: Column) -> Column:
    """A sentence from a name that begins with a known verb, in either style; else null."""
    words = F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), "_", " "))
    verb = F.element_at(F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv]), F.regexp_extract(words, r"^(\S+) ", 1))
    return F.when(~F.startswith(name, F.lit("__")) & verb.isNotNull(), F.concat(verb, F.lit(" "), F.regexp_extract(words, r"^\S+ (.*)$", 1), F.lit(".")))


def summaries(nodes: DataFrame) -> DataFrame:
    """id and summary of each symbol: of its documentation, else of its name, else what it is; with where it came from."""
    n = nodes.where(~F.col("type").isin("file", "module", "external_symbol"))
    said, named = first_sentence(F.col("docstring")), phrase(F.col("name"))
    plain = F.concat(F.initcap("type"), F.lit(" "), F.coalesce("name", F.lit("?")), F.lit("."))
    return n.select("id", F.coalesce(said, named, plain).alias("summary"), F.when(said.isNotNull(), "docstring").when(named.isNotNull(), "name").otherwise("type").alias("origin"))


def signals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What each symbol's implementation uses, by words in the names of what it calls and imports and in its preview.

    Callees are reduced to flags before they are grouped, so a hub costs a row and no text.
    """
    hit = lambda text, words: F.coalesce(F.lower(text).rlike("|".join("\\Q" + w + "\\E" for w in words)), F.lit(False))
    called = edges.where("type in ('calls', 'imports')").select(F.col("source").alias("id"), F.regexp_extract("target", r"([^:.]*)$", 1).alias("t"))
    by_call = called.groupBy("id").agg(*[F.max(hit(F.col("t"), w).cast("int")).alias(k) for k, w in SIGNALS.items()])
    n = nodes.where("type in ('function', 'method', 'class', 'route', 'controller')").select("id", "type", "tags", "file_path", "code_preview")
    own = {k: F.greatest(hit(F.col("code_preview"), w).cast("int"), F.coalesce(F.col(k), F.lit(0))) == 1 for k, w in SIGNALS.items()}
    entry = F.col("type").isin("route", "controller") | F.coalesce(F.array_contains("tags", "route"), F.lit(False))
    return n.join(by_call, "id", "left").select("id", *[c.alias(k) for k, c in own.items()], entry.alias("is_framework_entry"), dims.is_coverage_test_path(F.col("file_path")).alias("is_test_code"))


def relationships(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Per symbol and kind of relation (callers, callees, tests, parents, references): how many, and the k surest; ties by id."""
    kind = F.when(F.col("type") == "calls", F.when(F.col("way") == 0, "callees").otherwise("callers")).when((F.col("type") == "tested_by") & (F.col("way") == 0), "tests").when((F.col("type") == "inherits") & (F.col("way") == 0), "parents").when(F.col("type") == "references", "references")
    ends = edges.select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), F.lit(0).alias("way")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"), F.lit(1).alias("way")))), "type", "confidence")
    e = ends.withColumn("kind", kind).where("kind is not null").groupBy("id", "kind", "other").agg(F.max("confidence").alias("c"))
    e = e.join(nodes.where(~F.col("type").isin("file", "module", "external_symbol")).select("id"), "id", "left_semi")
    counts = e.groupBy("id", "kind").agg(F.count("*").alias("n"))
    best = e.withColumn("rn", F.row_number().over(Window.partitionBy("id", "kind").orderBy(F.desc("c"), "other"))).where(F.col("rn") <= k)  # the limit is applied before the shuffle
    top = best.groupBy("id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "other"))), lambda x: x["other"]), ",").alias("best"))
    return counts.join(top, ["id", "kind"])


def quality(edges: DataFrame) -> DataFrame:
    """One row: edges by tier of their resolution and level of confidence."""
    tier = dims.tier(F.col("resolution"))
    return edges.agg(F.count("*").alias("n_edges"), *[F.count_if(tier == t).alias(f"n_{t}") for t in ("confirmed", "possible", "unresolved")], F.count_if(F.col("confidence") < dims.MEDIUM).alias("n_low"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def recall(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Per task the share of expected names that were found, and how much was returned; expected and got have task_id and name."""
    e, g = expected.select("task_id", "name").distinct(), got.select("task_id", "name").distinct().withColumn("hit", F.lit(1))
    n = e.join(g, ["task_id", "name"], "left").groupBy("task_id").agg(F.count("*").alias("n_expected"), F.count("hit").alias("n_found"))
    size = g.groupBy("task_id").agg(F.count("*").alias("n_returned"))
    return n.join(size, "task_id", "left").fillna(0, ["n_returned"]).withColumn("recall", F.round(F.col("n_found") / F.col("n_expected"), 4))
