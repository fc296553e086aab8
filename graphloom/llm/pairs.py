"""Functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.keys import clean_id, hashed, node_type
from graphloom.ingest.declarations import functions, sniff
from graphloom.llm.statements import plain, says_something
from graphloom.ingest.lexing import language_of
from graphloom.llm.sources import arrival_type, deliveries, last_of, per_file, text_of


def _functions(path: str, content: bytes | None, full: bool) -> Iterator[tuple]:
    lang, text = language_of(path), text_of(content)
    if lang is None or not text:
        return
    for language in sniff(text, lang):
        seen: set[str] = set()
        any_ = False
        for f in functions(text, language):
            any_ = True
            if f.name not in seen and says_something(f.doc, f.name, f.params):
                seen.add(f.name)
                yield (f"{path}::{f.name}", text[f.start : f.end], plain(f.doc), language) if full else (f"{path}::{f.name}",)
        if any_:
            return


def _extract(full: bool):
    fields = ("node_id", "code", "documentation", "language") if full else ("node_id",)

    def rows(path: str, arrival, content: bytes | None) -> Iterator[tuple]:
        yield path, arrival, [dict(zip(fields, f)) for f in _functions(path, content, full)]

    return rows


def _function_ids(nodes: DataFrame) -> DataFrame:
    """Ids of functions and methods once each, whatever lives and spellings of the type they have."""
    ids = nodes.where(node_type(F.col("type")).isin("function", "method")).select(clean_id(F.col("id")).alias("node_id"), "signature")
    return ids.where("node_id is not null").groupBy("node_id").agg(F.max("signature").alias("signature"))


def documented(files: DataFrame, nodes: DataFrame, full: bool = False) -> DataFrame:
    """Functions and methods of the graph that have a real documentation in their source.

    A lexer that knows strings and comments finds declarations and matches their braces; the
    documentation is the comment of the language's kind that ends directly above (the docstring
    in Python). It counts if words remain besides the names of the function and its parameters,
    tags and words that say nothing, and if it is more than a pointer elsewhere. Of several
    functions of one name in a file the first with a documentation counts. Broken files are read as far as they go; if
    a file has no function in its extension's language, it is read in the one it looks like.

    Files that are null, empty or not UTF-8 have no functions. Nodes of other types or without id
    and functions that are not in nodes give no rows.

    Returns node_id; with `full` also signature, code, documentation, language.
    """
    one = "node_id: string" + ", code: string, documentation: string, language: string" * full
    schema = f"file_path string, arrival {arrival_type(files)}, found array<struct<{one}>>"
    found = last_of(per_file(deliveries(files), _extract(full), schema, "file_path", "arrival", "content"), "found").select(F.inline("found"))
    ids = _function_ids(nodes)
    key = hashed("h", F.col("node_id"))
    if not full:
        return found.select("node_id", *key).join(ids.select(*key), ["h1", "h2"], "left_semi").select("node_id")
    return found.select("*", *key).join(ids.select(*key, "signature"), ["h1", "h2"]).select("node_id", "signature", "code", "documentation", "language")
