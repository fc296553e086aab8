"""Marks of files that nobody writes by hand: generated, squeezed, taken over, or data."""

from __future__ import annotations

import re
from typing import NamedTuple

import xxhash

from graphloom.ingest.declarations import functions
from graphloom.ingest.lexing import lex

#: Folders of copies of other projects, and of output of generators.
VENDOR_DIRS = frozenset("vendor third_party third-party thirdparty 3rdparty node_modules bower_components jspm_packages _vendor _vendored vendored extern externals deps site-packages Godeps".split())
GENERATED_DIRS = frozenset("generated __generated__ _generated gen-src generated-src generated-sources autogen".split())
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.go|_grpc\.pb\.go|\.g(?:\.i)?\.cs|\.designer\.cs|[._]generated\.\w+|[._]gen\.\w+|[._-]autogen\.\w+)$|^zz_generated[._]", re.I)
_SQUEEZED_NAME = re.compile(r"[.-]min\.[cm]?js$|\.bundle\.[cm]?js$|\.packed\.js$", re.I)

# What a header comment says. A subject other than the file (a report, a client) is no mark, nor is
# a first version that was generated and is maintained by hand since.
_TOOL = re.compile(
    r"""@generated\b | <auto-?generated\b | \bauto-?generated\b(?!\s+(?:stub|documentation|docs?|comment)) | \bmachine[- ]generated\b
    | \bcode\ generated\b | ^\W*generated\ (?:by|with|from|using|automatically|code|file)\b | \b(?:this|the)\ (?:file|code|module|class|source)\ (?:was|is|has\ been)\ (?:\w+ly\ )?(?:auto-?)?(?:generated|created\ automatically|produced)\b
    | \bcreated\ automatically\ by\b | \b(?:manual\ )?(?:changes|edits|modifications)\ (?:\w+\ ){0,4}will\ be\ (?:lost|overwritten)\b
    | \bdo\ not\ (?:edit|modify)\b(?!\s+(?:the|a|an|your)\s+(?!file|code|source|generated))""",
    re.I | re.X | re.M,
)
_BY_HAND = re.compile(r"\b(?:maintained|edited|written|changed|modified)\s+(?:\w+\s+)?by\s+hand\s+(?:since|now|afterwards)|\b(?:first|initial|original)\s+version\s+was\s+generated|\bno\s+longer\s+generated", re.I)
_TAKEN = re.compile(
    r"""^\W*vendored\ (?:from|copy|in)\b | \bimported\ from\ upstream\b | \bbundled\ copy\ of\b | ^\W*copied\ (?:verbatim\ )?from\ (?:the\ )?\S+\ (?:v\.?\ ?)?\d+\. | \bkeep\ in\ sync\ with\ upstream\b
    | \breport\ (?:problems|bugs|issues)\ to\ that\ project\b | ^\W*(?:from|taken\ from|part\ of)\ \S+\ v?\d+\.\d+[^\n]*\bunmodified\b""",
    re.I | re.X | re.M,
)


class Marks(NamedTuple):
    reason: str | None  # generated, minified, vendored, data
    layout: str | None  # what the layout alone says
    body: int | None  # digest of all code tokens
    units: list[tuple[int, int]]  # digest and number of tokens of each function
    tokens: int


#: A file is squeezed if its canonical layout has this many times the lines it has, and so long ones.
EXPANSION, LINE_CHARS = 5.0, 120
#: So is one in which this share of the spaces and line breaks of the canonical layout, so many at least, is missing.
GAPS, GAP_SHARE = 40, 0.8
_SPACED = frozenset("= == === != !== && || => -> += -= *= := + * < > <= >= ? ??".split())
#: A blob: so many literals, and this share of all words, numbers and strings or of their characters.
LITERALS, LITERAL_SHARE, LITERAL_CHARS = 20, 0.9, 0.93
#: Machine-made: so many statements of one shape and layout, and this share of all.
UNIFORM, UNIFORM_SHARE = 60, 0.97
#: Smaller bodies and functions are alike by chance.
BODY_TOKENS, UNIT_TOKENS = 40, 24


def header(text: str, tokens: list) -> str:
    """The comments before the first code (a docstring is no comment)."""
    out = []
    for k, a, z in tokens:
        if k != "c":
            break
        out.append(re.sub(r"(?m)^[ \t]*(?:/\*+!?|//+!?|\#+|\*+(?!/))|\*+/", " ", text[a:z]))
    return "\n".join(out)


def marks(path: str, text: str, lang: str | None) -> Marks:
    """What one file shows by itself, and digests by which copies of it are found elsewhere.

    The file is lexed, emitted again in its canonical layout, and the original layout compared
    with that: see layout_reason(). What a layout can't tell (a well-formed file that a tool wrote
    or that was taken over) is told by conventions: names of folders and files, header comments.
    """
    folders, name = path.split("/")[:-1], path.rsplit("/", 1)[-1]
    lexed = lex(text, lang or "javascript")
    tokens = lexed[0]
    code = [t for t in tokens if t[0] != "c"]
    head = header(text, tokens)
    layout = layout_reason(text, code, lang)
    reason = layout
    if any(f in VENDOR_DIRS for f in folders) or _TAKEN.search(head):
        reason = "vendored"
    elif any(f in GENERATED_DIRS for f in folders) or _GENERATED_NAME.search(name) or _TOOL.search(head) and not _BY_HAND.search(head):
        reason = "generated"
    elif _SQUEEZED_NAME.search(name):
        reason = "minified"
    digest = xxhash.xxh3_64_intdigest
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    joined = lambda ts: "\x1f".join([text[a:z] for _, a, z in ts])
    body = signed(digest(joined(code))) if len(code) >= BODY_TOKENS else None
    units = []
    if body is not None and lang and reason in (None, "vendored"):
        i = 0
        for f in functions(text, lang, lexed):
            while i < len(code) and code[i][1] < f.start:
                i += 1
            j = i
            while j < len(code) and code[j][1] < f.end:
                j += 1
            if j - i >= UNIT_TOKENS:
                units.append((signed(digest(joined(code[i:j]))), j - i))
    return Marks(reason, layout, body, units, len(code))


def emitted(text: str, code: list) -> tuple[str, list[bool]]:
    """The code in its canonical layout, and for each blank or line break that layout is free to leave out whether the original has it.

    A line per statement, block opening and block end outside of parentheses, indented by the
    depth of blocks; a blank behind commas, around assignments, arrows and comparisons, before a
    block; one between two words. Nothing else.
    """
    out: list[str] = []
    kept: list[bool] = []
    depth = level = 0
    b, end = "", 0
    for k, a, z in code:
        free = b in (",", ";") and k not in (")", "]", "}") or depth <= 0 and (k in _SPACED or b in _SPACED) or k == "{" and b == ")"
        if free:
            kept.append(end != a)
        if k == "}" and depth <= 0:
            level = max(0, level - 1)
        if out:
            if b in (";", "{", "}") and depth <= 0:
                out.append("\n" + "  " * level)
            elif free or b in ("w", "n", "s") and k in ("w", "n", "s"):
                out.append(" ")
        out.append(text[a:z])
        if k in ("(", "["):
            depth += 1
        elif k in (")", "]"):
            depth -= 1
        elif k == "{" and depth <= 0:
            level += 1
        b, end = k, z
    return "".join(out), kept


def layout_reason(text: str, code: list, lang: str | None) -> str | None:
    """What the original layout says against the canonical one.

    `data`: nearly all words are literals. `minified`: what the canonical layout has and the
    original lacks, blanks and breaks (GAP_SHARE of them) or lines (EXPANSION times as many, the
    original's being long). `generated`: perfect uniformity, line after line of one shape.
    """
    if not code:
        return None
    size = {"w": 0, "n": 0, "s": 0}
    number = {"w": 0, "n": 0, "s": 0}
    for k, a, z in code:
        if k in size:
            size[k] += z - a
            number[k] += 1
    literals, chars = number["n"] + number["s"], size["n"] + size["s"]
    if literals >= LITERALS and (literals >= LITERAL_SHARE * (number["w"] + literals) or chars >= LITERAL_CHARS * (size["w"] + chars)):
        return "data"
    canonical, kept = emitted(text, code)
    if len(kept) >= GAPS and kept.count(False) >= GAP_SHARE * len(kept):
        return "minified"
    numbers = list(_line_numbers(text, code))
    rows, lines = len(set(numbers)), canonical.count("\n") + 1
    if lang != "python" and lines >= EXPANSION * rows and len(text) >= LINE_CHARS * rows and lines >= 20:
        return "minified"
    shapes: dict[str, int] = {}
    row: list[str] = []
    total, last = 0, -1
    for (k, _, _), r in zip(code, numbers):
        if r != last and row:
            s = " ".join(row)
            shapes[s] = shapes.get(s, 0) + 1
            total += 1
            row = []
        last = r
        row.append(k)
    if total >= UNIFORM and max(shapes.values()) >= UNIFORM_SHARE * total:
        return "generated"
    return None


def _line_numbers(text: str, code: list):
    line, seen = 0, 0
    for _, a, _ in code:
        line += text.count("\n", seen, a)
        seen = a
        yield line
