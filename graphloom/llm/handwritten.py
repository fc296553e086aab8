"""Files that nobody writes by hand, so that only hand-written source remains."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.ingest.lexing import language_of
from graphloom.llm.origin import marks
from graphloom.llm.sources import arrival_type, deliveries, last_of, per_file, text_of
from graphloom.runtime import cut

COPY_SHARE = 0.5  # of a file's function tokens that are found in files taken over


def _marks(path: str, arrival, content: bytes | None, repo: str | None) -> Iterator[tuple]:
    text = text_of(content)
    m = marks(path, text if text is not None else (content or b"").decode("latin-1"), language_of(path))
    units = [{"h": h, "n": n} for h, n in dict(m.units).items()]
    yield path, arrival, repo or path.split("/", 1)[0], m.reason, m.layout, m.body, units, sum(u["n"] for u in units)


def not_by_hand(files: DataFrame) -> DataFrame:
    """Files that are generated, minified, vendored or data, with the reason.

    What a file shows by itself (layout against its canonical form, literals, names, header
    comment) is found in one pass. Copies of other projects' files are found wherever they lie:
    the digest of all code tokens, comments left out, is that of a file which is marked as taken
    over, or is in more than one repository; or at least half of the tokens in functions are in
    functions of such files. Only digests are shuffled; a digest that many files share is counted
    map-side, and adaptive skew handling splits it in the join.

    Files without content show only their name. A file without a known extension is lexed like
    JavaScript. Repeated rows count once.

    Returns file_path, reason, and signal: what shows it, `layout` (the layout alone would), else
    `convention` (a name or header comment) or `copy`.
    """
    schema = f"file_path string, arrival {arrival_type(files)}, repo_id string, reason string, layout string, body bigint, units array<struct<h: bigint, n: int>>, n_tokens int"
    m = cut(last_of(per_file(deliveries(files, "repo_id"), _marks, schema, "file_path", "arrival", "content", "repo_id"), "repo_id", "reason", "layout", "body", "units", "n_tokens"))
    by_body = m.where("body is not null").groupBy("body").agg(F.max((F.col("reason") == "vendored").cast("int")).alias("taken"), F.min("repo_id").alias("a"), F.max("repo_id").alias("z"))
    copied = by_body.where("taken = 1 or a <> z").select("body")
    taken_units = m.where("reason = 'vendored'").select(F.explode("units.h").alias("h")).distinct()
    open_ = m.where("reason is null")
    whole = open_.join(copied, "body", "left_semi").select("file_path")
    share = (
        open_.select("file_path", "n_tokens", F.explode("units").alias("u"))
        .select("file_path", "n_tokens", F.col("u.h").alias("h"), F.col("u.n").alias("n"))
        .join(taken_units, "h", "left_semi")
        .groupBy("file_path", "n_tokens")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= COPY_SHARE * F.col("n_tokens"))
        .select("file_path")
    )
    copies = whole.unionByName(share).distinct().select("file_path", F.lit("vendored").alias("reason"), F.lit("copy").alias("signal"))
    by = F.when(F.col("layout").isNotNull(), "layout").otherwise("convention")
    return m.where("reason is not null").select("file_path", "reason", by.alias("signal")).unionByName(copies)
