"""Source files that do not parse."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.grammar import marked_up, python_fits, statements_fit
from graphloom.ingest.lexing import CODE, IN_TEMPLATE, LINE, STATES, brackets, join_brackets, language_of, lex
from graphloom.llm.sources import arrival_type, deliveries, last_of, per_file, text_of
from graphloom.runtime import cut, portable, task_count

CHUNK_CHARS = 1 << 18
#: What tokens that no language has are called; the smaller counts before the other.
_BAD = {"x": "conflict marker", "e": "no token"}
_CUT = re.compile(r"[\n;{},]")
_FRESH = re.compile(r"\s*(?:function|class|const|let|var|import|export|if|for|switch|interface|type|enum|func|public|private|internal|namespace|using|@|\[|\Z)")
_PY_FRESH = re.compile(r"\n(?=(?:def|class|import|from|async|if|for|while|with|try|@|[A-Za-z_]\w* *=))")


def chunks(text: str, size: int) -> Iterator[str]:
    """Pieces that end behind a character which is no part of a longer token."""
    a = 0
    while a < len(text):
        m = _CUT.search(text, min(a + size, len(text)))
        b = m.end() if m else len(text)
        yield text[a:b]
        a = b


def _entry(text: str, tokens: list, end: str) -> tuple:
    """What a chunk does that is entered in one state: the state behind it, its bracket summary, and what it has that no language has."""
    if end == LINE and text.endswith("\n"):
        end = CODE
    return end, brackets(tokens), min((_BAD[k] for k, _, _ in tokens if k in _BAD), default="")


def state_map(text: str, lang: str, first: bool) -> dict:
    """_entry() for each lexer state in which a chunk may be entered."""
    return {s: _entry(text, *lex(text, lang, s)) for s in ((CODE,) if first else STATES[lang])}


def compose(left: dict, right: dict) -> dict:
    """The state map of two texts one after the other; associative."""
    out = {}
    for s, (mid, b, bad) in left.items():
        end, b2, bad2 = right.get(mid, right[CODE])
        out[s] = (end, join_brackets(tuple(b), tuple(b2)), min(filter(None, (bad, bad2)), default=""))
    return out


def _open(m: dict) -> str:
    return m[CODE][1][1]


def _whole(m: dict) -> str | None:
    """What the state map of a whole file complains of."""
    end, (shut, opened, crossed), bad = m[CODE]
    return "unterminated" if end not in (CODE, LINE, IN_TEMPLATE) else bad if bad else "bracket" if shut or opened or crossed else None


def _statements(text: str, lang: str, first: bool) -> str | None:
    return python_fits(text) if lang == "python" else statements_fit(text, lex(text, lang)[0], lang, first=first)


def verdict(text: str, lang: str, markup: bool = False) -> str | None:
    """What is wrong with a text that is one chunk: the same steps as for several, the tokens lexed once.

    The map of the only chunk has the one state in which a file begins; its statements of the top
    level are cut into segments, and each segment is parsed by itself.
    """
    tokens, end = lex(text, lang, markup=markup)
    wrong = _whole({CODE: _entry(text, tokens, end)})
    if wrong:
        return wrong
    at = _cuts(text, lang, CODE, "", tokens, end)
    bounds = [0, *(at[:1] + at[-1:] if len(at) > 1 else at), len(text)]
    i = 0
    for a, z in zip(bounds, bounds[1:]):
        if lang == "python":
            wrong = python_fits(text[a:z])
        else:
            j = i
            while j < len(tokens) and tokens[j][1] < z:
                j += 1
            wrong = statements_fit(text, tokens[i:j], lang, first=a == 0)
            i = j
        if wrong:
            return wrong
    return None


def _verdicts(size: int):
    def rows(path: str, arrival, content: bytes | None) -> Iterator[tuple]:
        lang, text = language_of(path), text_of(content)
        if lang is None:
            return
        markup = text is not None and path.lower().endswith((".jsx", ".tsx", ".js")) and marked_up(text)
        if text is None:
            yield path, arrival, lang, "encoding", None, None, None
        elif markup or len(text) <= size:
            yield path, arrival, lang, verdict(text, lang, markup), None, None, None
        else:
            d = xxhash.xxh3_64_intdigest(f"{arrival}\0{text}".encode("utf-8", "surrogatepass")) >> 1
            for i, c in enumerate(chunks(text, size)):
                yield path, arrival, lang, None, i, c, d

    return rows


def _maps(path: str, lang: str, no: int, text: str) -> Iterator[tuple]:
    yield path, lang, no, json.dumps(state_map(text, lang, no == 0))


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """A file's chunk maps in order: the state and open brackets before each chunk, or what is wrong with the whole."""
    pdf = pdf.sort_values("no")
    path, lang = pdf["file_path"].iloc[0], pdf["language"].iloc[0]
    done, rows = None, []
    for no, m in zip(pdf["no"], pdf["map"]):
        state, opened = (CODE, "") if done is None else (done[CODE][0], _open(done))
        rows.append((path, lang, int(no), state, opened, None))
        m = json.loads(m)
        done = m if done is None else compose(done, m)
    wrong = _whole(done)
    if wrong:
        rows = [(path, lang, -1, None, None, wrong)]
    return pd.DataFrame(rows, columns=["file_path", "language", "no", "state", "opened", "complaint"])


def _cuts(text: str, lang: str, state: str, opened: str, tokens: list, end: str) -> list[int]:
    """Places in a chunk where a statement of the top level begins."""
    depth, at = len(opened), []
    code = [t for t in tokens if t[0] != "c"]
    if lang == "python":
        inside = [(a, z) for k, a, z in tokens if k in ("s", "c")]
        if state != CODE:  # a string that began before
            inside.append((-1, tokens[0][1] if tokens else len(text)))
        if end not in (CODE, LINE):  # one that goes on behind
            inside.append((tokens[-1][2] if tokens else -1, len(text) + 1))
        flat, d, i = [], depth, 0
        for m in _PY_FRESH.finditer(text):
            while i < len(code) and code[i][1] <= m.start():
                d += (code[i][0] in ("(", "[", "{")) - (code[i][0] in (")", "]", "}"))
                i += 1
            line = text[: m.start()].rsplit("\n", 1)[-1]
            if d == 0 and not line.startswith("@") and not line.rstrip().endswith(("\\", ":")) and not any(a < m.start() < z for a, z in inside):
                flat.append(m.end())
        return flat
    for i, (k, _, z) in enumerate(code):
        depth += (k in ("(", "[", "{", "${")) - (k in (")", "]", "}"))
        if depth == 0 and k in (";", "}") and "\n" in text[z : code[i + 1][1] if i + 1 < len(code) else len(text)] and (k == ";" or _FRESH.match(text, z)):
            at.append(z)
    return at


def _pieces(path: str, lang: str, no: int, text: str, state: str, opened: str) -> Iterator[tuple]:
    """The chunk cut into what belongs to an earlier segment, whole statements, and the beginning of the next segment."""
    at = _cuts(text, lang, state, opened, *lex(text, lang, state))
    if not at:
        yield path, lang, no, 0, text, False
        return
    yield path, lang, no, 0, text[: at[0]], False
    if at[-1] > at[0]:
        yield path, lang, no, 1, text[at[0] : at[-1]], True
    yield path, lang, no, 2, text[at[-1] :], True


def _segments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Parse the statements of one segment."""
    pdf = pdf.sort_values(["no", "part"])
    path, lang = pdf["file_path"].iloc[0], pdf["language"].iloc[0]
    text = "".join(pdf["text"])
    wrong = _statements(text, lang, int(key[1]) == 0)
    return pd.DataFrame([(path, lang, wrong)], columns=["file_path", "language", "complaint"])


def check_syntax(files: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Whether each file is valid source of the language of its extension.

    Every file goes the same way. It is cut into chunks; each chunk gives, for every lexer state it
    may be entered in, the state behind it and a summary of its brackets; these compose
    associatively. With the state before each chunk known, statements of the top level are put
    together across chunks and each segment is parsed by itself. A file of up to chunk_chars is one
    chunk and takes these steps where it lies (verdict()); those of a longer one run in many tasks.
    Text with markup in expressions is one chunk whatever its length, since elements nest without
    bound and a chunk would have to be entered at any depth. Python's own parser is the exact check
    of its statements; the other languages' grammars are regular expressions over letters for
    tokens and bracket groups, which accept somewhat more than the language.

    A null or empty content is an empty text (valid but in Go); what is not UTF-8 is invalid. Files
    with another extension give no row. Of rows that came again the one that arrived last counts.

    Returns file_path, language, complaint (null: valid).
    """
    spark = files.sparkSession
    schema = f"file_path string, arrival {arrival_type(files)}, language string, complaint string, no int, text string, delivery bigint"
    first = cut(per_file(deliveries(files), _verdicts(chunk_chars), schema, "file_path", "arrival", "content"))
    small = first.where("no is null").select("file_path", "arrival", "language", "complaint")
    chunked = first.where("no is not null")
    if chunked.isEmpty():
        return last_of(small, "language", "complaint")
    # deliveries of one path are files of their own until the end
    chunked = chunked.withColumn("of", F.concat_ws("\0", "file_path", "delivery"))
    of = chunked.groupBy("of").agg(F.max("file_path").alias("path"), F.max("arrival").alias("arrival"))
    long = chunked.select(F.col("of").alias("file_path"), "language", "no", "text").repartition(task_count(files.sparkSession, chunked), "file_path", "no").dropDuplicates(["file_path", "no"])
    maps = per_file(long, _maps, "file_path string, language string, no int, map string", "file_path", "language", "no", "text")
    entered = cut(maps.groupBy("file_path").applyInPandas(portable(_fold, "frame"), "file_path string, language string, no int, state string, opened string, complaint string"))
    whole = entered.where("no = -1").select("file_path", "language", "complaint")
    known = long.join(entered.where("no >= 0").select("file_path", "no", "state", "opened"), ["file_path", "no"])
    pieces = per_file(known, _pieces, "file_path string, language string, no int, part int, text string, fresh boolean", "file_path", "language", "no", "text", "state", "opened")
    w = F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("file_path").orderBy("no", "part"))
    segments = pieces.withColumn("segment", F.coalesce(w, F.lit(0)))
    parsed = segments.groupBy("file_path", "segment").applyInPandas(portable(_segments, "keyed"), "file_path string, language string, complaint string")
    both = whole.unionByName(parsed.groupBy("file_path", "language").agg(F.min("complaint").alias("complaint")))
    long_ones = both.withColumnRenamed("file_path", "of").join(of, "of").select(F.col("path").alias("file_path"), "arrival", "language", "complaint")
    return last_of(small.unionByName(long_ones), "language", "complaint")


def failure_rates(checked: DataFrame, files: DataFrame, summary: DataFrame) -> DataFrame:
    """Files that do not parse per repository and language, beside what the index runs reported.

    A run's repeated rows count once (the greatest number); a null report counts as none.
    """
    repo = files.where("file_path is not null").groupBy("file_path").agg(F.max("repo_id").alias("repo_id"))
    ours = (
        checked.join(repo, "file_path")
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("n_files"), F.sum(F.col("complaint").isNotNull().cast("long")).alias("n_invalid"))
        .withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
    runs = summary.groupBy("repo_id", "batch_no").agg(F.max("failed_files").alias("f")).groupBy("repo_id").agg(F.sum(F.coalesce("f", F.lit(0)).cast("long")).alias("reported_failed"))
    return ours.join(runs, "repo_id", "left")
