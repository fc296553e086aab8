"""Declarations in source text: functions and methods with the documentation comment that belongs to each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from graphloom.ingest.lexing import lex


class Function(NamedTuple):
    name: str  # with the class, `Class.name`, for a method
    params: str
    start: int  # of the declaration with decorators, annotations and modifiers
    end: int
    line: int
    doc: str | None  # as written, with its markers


_MODIFIERS = frozenset("export default async const let var declare abstract public private protected static get set readonly override final".split())
_CLASSES = {"java": {"class", "interface", "enum", "record"}, "csharp": {"class", "struct", "interface", "enum", "record"}, "javascript": {"class"}, "typescript": {"class"}}
_NO_METHOD = frozenset("if for while switch catch return new throw else do try synchronized using lock foreach fixed await super this typeof sizeof nameof function".split())
_BREAK = re.compile(r"\r\n|\r|\n")
_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}|={7}|\|{7})(?: [^\n]*)?\n")


def functions(text: str, lang: str, lexed: tuple[list, str] | None = None) -> Iterator[Function]:
    """All functions of a text, in order; bodies are skipped, so none within another.

    `lexed` is what lex() gave for the text, where that is known. Works on broken text too: conflict markers are skipped, an open body ends with the text.
    """
    tokens, state = lexed or lex(text, lang)
    tokens = [t for t in tokens if t[0] not in ("x", "e")]
    if lang == "python":
        yield from _python(text, tokens, state)
    else:
        yield from _braced(text, tokens, lang)


def _python(text: str, tokens: list, state: str) -> Iterator[Function]:
    sig = [t for t in tokens if t[0] != "c"]
    n = len(sig)
    scopes: list[tuple[int, str, bool]] = []  # indent, name, is class
    line, seen = 1, 0
    i = 0
    while i < n:
        k, a, z = sig[i]
        word = text[a:z] if k == "w" else ""
        if word not in ("def", "class") or i + 1 >= n or sig[i + 1][0] != "w":
            i += 1
            continue
        bol = max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1
        lead = text[bol:a]
        if lead.strip() not in ("", "async"):
            i += 1
            continue
        indent = len(lead) - len(lead.lstrip())
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        name = text[sig[i + 1][1] : sig[i + 1][2]]
        inside_function = any(not s[2] for s in scopes)
        scopes.append((indent, name, word == "class"))
        if word == "class" or inside_function:
            i += 2
            continue
        j, depth = i + 2, 0
        params = ("", 0, 0)
        while j < n:
            c = sig[j][0]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == ":" and depth == 0:
                break
            j += 1
        head = text[sig[i + 1][2] : sig[j][1] if j < n else len(text)]
        params = head
        doc = None
        if j + 1 < n and sig[j + 1][0] == "s" and (j + 2 >= n or _BREAK.search(text[sig[j + 1][2] : sig[j + 2][1]]) or sig[j + 2][0] == ";"):
            s = text[sig[j + 1][1] : sig[j + 1][2]]
            if not re.match(r"\w*[fFbB]\w*[\"']", s):
                doc = s
        elif j + 1 == n and j < n and state in ('"""', "'''"):
            rest = re.sub(r"^(?:\s*(?:#[^\n\r]*)?[\n\r]+)*\s*", "", text[sig[j][2] :])
            doc = rest if re.match(r"[rRuU]?(?:\"\"\"|''')", rest) else None
        line += len(_BREAK.findall(text, seen, a))
        seen = a
        end = _python_end(text, sig[j][2] if j < n else z, indent)
        yield Function(".".join([s[1] for s in scopes[:-1]] + [name]), params, bol + indent, end, line, doc)
        i = j


def _python_end(text: str, pos: int, indent: int) -> int:
    m = re.compile(rf"^[ \t]{{0,{indent}}}(?=[^\s#)\]}}])", re.M).search(text, pos)
    return m.start() if m else len(text)


def _braced(text: str, tokens: list, lang: str) -> Iterator[Function]:
    sig = [i for i, t in enumerate(tokens) if t[0] != "c"]
    kind = [tokens[i][0] for i in sig]
    word = [text[tokens[i][1] : tokens[i][2]] if tokens[i][0] == "w" else "" for i in sig]
    n = len(sig)
    match = [n] * n
    opened: list[int] = []
    for i, k in enumerate(kind):
        if k in ("(", "[", "{", "${"):
            opened.append(i)
        elif k in (")", "]", "}") and opened:
            match[opened.pop()] = i
    line, seen = 1, 0

    def made(name: str, start: int, paren: int, end: int) -> Function:
        nonlocal line, seen
        a = tokens[sig[start]][1]
        line += len(_BREAK.findall(text, seen, a))
        seen = max(seen, a)
        close = match[paren]
        z = tokens[sig[end]][2] if end < n else len(text)
        return Function(name, text[tokens[sig[paren]][2] : tokens[sig[close]][1] if close < n else len(text)], a, z, line, _doc_above(text, tokens, sig[start], lang))

    def body_end(i: int) -> int:
        """The end of what follows a parameter list: the body, an expression or a semicolon."""
        while i < n:
            if kind[i] == "{":
                return match[i]
            if kind[i] == ";" or kind[i] == "}":
                return i
            i = match[i] + 1 if kind[i] in ("(", "[") and match[i] < n else i + 1
        return n

    scopes: list[tuple[int, str]] = []  # closing index, class name
    i = 0
    while i < n:
        while scopes and i >= scopes[-1][0]:
            scopes.pop()
        in_class = bool(scopes) and scopes[-1][1] != ""
        w = word[i]
        if lang == "go":
            if w == "func":
                j, owner = i + 1, ""
                if j < n and kind[j] == "(":
                    owner = next((word[x] for x in range(min(match[j], n) - 1, j, -1) if word[x]), "")
                    j = match[j] + 1
                if j + 1 < n and word[j] and kind[j + 1] in ("(", "["):
                    p = match[j + 1] + 1 if kind[j + 1] == "[" else j + 1
                    if p < n and kind[p] == "(":
                        end = _go_end(kind, match, p, n)
                        yield made(f"{owner}.{word[j]}" if owner else word[j], i, p, end)
                        i = end + 1
                        continue
            if kind[i] in ("{", "(") and match[i] < n:
                i = match[i]
            i += 1
            continue
        if w in _CLASSES[lang] and i + 1 < n and word[i + 1] and (i == 0 or kind[i - 1] != "."):
            j = i + 2
            while j < n and kind[j] not in ("{", ";"):
                j = match[j] + 1 if kind[j] == "(" and match[j] < n else j + 1
            if j < n and kind[j] == "{":
                scopes.append((match[j], word[i + 1]))
                i = j + 1
                continue
        if lang in ("csharp", "typescript") and w in ("namespace", "module") and i + 1 < n and word[i + 1] and not in_class:
            j = i + 1
            while j < n and kind[j] not in ("{", ";"):
                j += 1
            if j < n and kind[j] == "{":
                scopes.append((match[j], ""))
            i = j + 1
            continue
        owner = ".".join(s[1] for s in scopes if s[1])
        if lang in ("javascript", "typescript") and not in_class:
            paren = name = None
            if w == "function":
                j = i + 1 + (i + 1 < n and kind[i + 1] == "*")
                if j < n and word[j]:
                    p = _to_paren(kind, word, j + 1, n)
                    if p is not None:
                        paren, name = p, word[j]
            elif w in ("const", "let", "var") and i + 2 < n and word[i + 1]:
                p = _arrow_params(kind, word, match, i + 2, n)
                if p is not None:
                    paren, name = p, word[i + 1]
            if name:
                end = body_end(match[paren] + 1)
                yield made(name, _back(kind, word, match, i), paren, end)
                i = end + 1
                continue
        elif in_class and w and w not in _NO_METHOD and i + 1 < n:
            p = _to_paren(kind, word, i + 1, n)
            if p is not None and (i == 0 or kind[i - 1] not in (".", "=", "@") and word[i - 1] not in ("new", "return")):
                after = match[p] + 1
                nxt = kind[after] if after < n else "{"
                ok = nxt in ("{", ";", "=>", ":") or after < n and word[after] in ("throws", "where")
                if ok and not (nxt == ";" and lang in ("javascript",)):
                    end = body_end(after)
                    start = _back(kind, word, match, i) if lang in ("javascript", "typescript") else _boundary(kind, match, i)
                    yield made(f"{owner}.{w}", start, p, end)
                    i = end + 1
                    continue
        if kind[i] == "=" and in_class or kind[i] in ("(", "["):
            if kind[i] == "=":
                i = _skip_value(kind, match, i, n)
            else:
                i = match[i]
        elif kind[i] == "{":
            i = match[i]
        i += 1


def _go_end(kind: list, match: list, p: int, n: int) -> int:
    i = match[p] + 1
    while i < n and kind[i] not in ("{",):
        i = match[i] + 1 if kind[i] in ("(", "[") and match[i] < n else i + 1
    return match[i] if i < n else n


def _to_paren(kind: list, word: list, i: int, n: int) -> int | None:
    """The parenthesis of the parameters, behind type parameters if there are some."""
    if i < n and kind[i] == "<":
        depth = 0
        while i < n:
            depth += {"<": 1, ">": -1, ">>": -2}.get(kind[i], 0)
            if kind[i] in ("{", ";", "=") or depth <= 0:
                break
            i += 1
        i += 1
    return i if i < n and kind[i] == "(" else None


def _arrow_params(kind: list, word: list, match: list, i: int, n: int) -> int | None:
    """Where the parameters of `= (…) =>` or `= function (…)` begin, from behind the name."""
    while i < n and kind[i] not in ("=", ";"):
        i = match[i] + 1 if kind[i] in ("(", "{", "[") and match[i] < n else i + 1
    i += 1
    if i < n and word[i] == "async":
        i += 1
    if i < n and word[i] == "function":
        i += 1 + (i + 1 < n and bool(word[i + 1]))
        return i if i < n and kind[i] == "(" else None
    p = _to_paren(kind, word, i, n)
    if p is None:
        return i if i + 1 < n and word[i] and kind[i + 1] == "=>" else None
    j = match[p] + 1
    while j < n and kind[j] not in ("=>", ";", "{", "="):
        j = match[j] + 1 if kind[j] in ("(", "[") and match[j] < n else j + 1
    return p if j < n and kind[j] == "=>" else None


def _skip_value(kind: list, match: list, i: int, n: int) -> int:
    while i < n and kind[i] not in (";", "}"):
        i = match[i] + 1 if kind[i] in ("(", "[", "{") and match[i] < n else i + 1
    return i


def _back(kind: list, word: list, match: list, i: int) -> int:
    """The first token of a declaration: modifiers and decorators before it."""
    while i > 0:
        if word[i - 1] in _MODIFIERS or kind[i - 1] in ("@", "*"):
            i -= 1
        elif i > 1 and kind[i - 2] == "@" and word[i - 1]:
            i -= 2
        elif kind[i - 1] == ")":
            o = next((x for x in range(i - 2, -1, -1) if match[x] == i - 1), None)
            if o and o > 1 and word[o - 1] and kind[o - 2] == "@":
                i = o - 2
            else:
                return i
        else:
            return i
    return i


def _boundary(kind: list, match: list, i: int) -> int:
    while i > 0 and kind[i - 1] not in (";", "}", "{"):
        i -= 1
    return i


def _doc_above(text: str, tokens: list, start: int, lang: str) -> str | None:
    """The documentation comment that ends on the line above a declaration (or on its line)."""
    i, below = start - 1, tokens[start][1]
    found: list[str] = []
    while i >= 0 and tokens[i][0] == "c":
        _, a, z = tokens[i]
        if len(_BREAK.findall(_CONFLICT.sub("", text[z:below]))) > 1:
            break
        s = text[a:z]
        if lang in ("java", "javascript", "typescript"):
            return s if s.startswith("/**") and s != "/**/" else None
        if lang == "csharp":
            if not s.startswith("///"):
                break
        elif s.startswith("/*"):
            if not found:
                return s
            break
        elif re.match(r"//(?:go:|line |export |\s*\+build)", s):
            i -= 1
            below = a
            continue
        found.append(s)
        i, below = i - 1, a
    return "\n".join(reversed(found)) or None


def sniff(text: str, first: str) -> list[str]:
    """Languages to read a text in: the one its extension stands for, then others by what it looks like."""
    hints = {
        "python": r"^[ \t]*(?:async )?def \w+\(|^from [\w.]+ import ", "go": r"^func |^package \w+\s*$", "csharp": r"^\s*namespace [\w.]+|^using [\w.]+;", "java": r"^package [\w.]+;|^import [\w.]+;",
        "typescript": r"^(?:export )?(?:async )?function \w+\(|^import .* from |^(?:export )?const \w+ = |require\(",
    }
    count = {k: len(re.findall(p, text, re.M)) for k, p in hints.items()}
    best = max(count, key=lambda k: count[k])
    return [first] if not count[best] or best == first or {best, first} <= {"typescript", "javascript"} else [best, first] if not count.get("typescript" if first == "javascript" else first) else [first, best]
