"""String- and comment-aware lexers for the six languages, enterable in any lexer state.

A token is (kind, start, end). Kinds: `w` word, `n` number, `s` string or character, `r` regular
expression, `c` comment, `x` conflict marker, `e` what the language has no token for, and for
brackets and operators their own text. `${` opens an interpolation that `}` closes.
"""

from __future__ import annotations

import re
from functools import cache

LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "cs": "csharp",
}
CODE = ""
LINE, BLOCK = "//", "/*"
IN_TEMPLATE = "${"
IN_MARKUP = "<"

_MARK = r"^(?:<{7}|>{7}|={7}|\|{7})(?![<>=|])[^\n\r]*"
_CONFLICTS = re.compile(_MARK, re.M)
_WORD = r"[^\W\d]\w*"
_NUMBER = r"\.?\d(?:[eEpP][+-]|\.(?!\.)|\w)*"
_DQ, _SQ = r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"', r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"
_C_COMMENT = r"//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/"
_OPS = {
    "python": r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|[-+*/%@&|^=<>!]=|[-+*/%@&|^~<>=.,:;()\[\]{}]",
    "javascript": r">>>=|\*\*=|<<=|>>=|>>>|===|!==|\.\.\.|&&=|\|\|=|\?\?=|=>|\+\+|--|\*\*|&&|\|\||\?\?|\?\.(?!\d)|<<|>>|[-+*/%&|^=<>!]=|[-+*/%&|^~<>=.,:;?!()\[\]{}@]",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[-+*/%&|^=<>!]=|[-+*/%&|^~<>=.,:;?!()\[\]{}@]",
    "csharp": r"\?\?=|<<=|>>=|=>|->|::|\+\+|--|&&|\|\||\?\?|\?\.|\.\.|[-+*/%&|^=<>!]=|[-+*/%&|^~<>=.,:;?!()\[\]{}]",
    "go": r"<<=|>>=|&\^=|\.\.\.|:=|<-|\+\+|--|&&|\|\||&\^|<<|>>|[-+*/%&|^=<>!]=|[-+*/%&|^~<>=.,:;!()\[\]{}]",
}
_OPS["typescript"] = _OPS["javascript"]
_STRINGS = {
    "python": r"(?:[rRbBuUfF]{1,2})?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|(?!\"\"\")" + _DQ + "|(?!''')" + _SQ + ")",
    "javascript": _DQ + "|" + _SQ + r"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`",
    "java": r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|(?!""")' + _DQ + r"|'(?:[^'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'",
    "csharp": r'"""(?:[^"]|"(?!""))*"""|[$@]{0,2}@[$@]?"(?:[^"]|"")*"|\$?(?!""")' + _DQ + r"|'(?:[^'\\\n\r]|\\(?:[uUx][0-9a-fA-F]+|.))'",
    "go": r'"(?:[^"\\\n\r]|\\.)*"|`[^`]*`' + r"|'(?:[^'\\\n\r]|\\(?:[xuU][0-9a-fA-F]+|[0-7]{3}|.))'",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_COMMENTS = {k: _C_COMMENT for k in ("javascript", "typescript", "java", "csharp", "go")} | {"python": r"#[^\n\r]*"}
_COMMENTS["csharp"] += r"|^[ \t]*\#[ \t]*(?:region|endregion|if|elif|else|endif|pragma|define|undef|nullable|line|warning|error)\b[^\n\r]*"
for _js in ("javascript", "typescript"):
    _COMMENTS[_js] += r"|\A#![^\n\r]*"
_WORDS = {k: _WORD for k in _OPS}
_WORDS["javascript"] = _WORDS["typescript"] = r"\#?(?:[^\W\d]|\$)[\w$]*"
_WORDS["java"] = r"(?:[^\W\d]|\$)[\w$]*"
_WORDS["csharp"] = r"@?[^\W\d]\w*"
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")

#: What ends a state that a chunk is entered in.
_END = {
    LINE: re.compile(r"[^\n\r]*(?=[\n\r])"),
    BLOCK: re.compile(r"(?:[^*]|\*(?!/))*\*/"),
    '"': re.compile(r'(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*(?:"|(?=[\n\r]))'),
    "'": re.compile(r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*(?:'|(?=[\n\r]))"),
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    "`": re.compile(r"[^`]*`"),
    '@"': re.compile(r'(?:[^"]|"")*"(?!")'),
    "/": re.compile(r"(?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])*(?:/[a-z]*|(?=[\n\r]))"),
    "/[": re.compile(r"(?:[^\]\\\n\r]|\\.)*(?:\](?:[^/\\\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])*(?:/[a-z]*|(?=[\n\r]))|(?=[\n\r]))"),
}
STATES = {
    "python": (CODE, LINE, '"', "'", '"""', "'''"),
    "javascript": (CODE, IN_TEMPLATE, LINE, BLOCK, '"', "'", "`", "/", "/["),
    "typescript": (CODE, IN_TEMPLATE, LINE, BLOCK, '"', "'", "`", "/", "/["),
    "java": (CODE, LINE, BLOCK, '"', "'", '"""'),
    "go": (CODE, LINE, BLOCK, '"', "'", "`"),
    "csharp": (CODE, LINE, BLOCK, '"', "'", '"""', '@"'),
}
_OPENERS = {
    "python": r"\"\"\"|'''|[\"']", "javascript": r"/\*|[\"'`]", "typescript": r"/\*|[\"'`]", "java": r"/\*|\"\"\"|[\"']", "csharp": r"/\*|\"\"\"|[$@]*\"|'", "go": r"/\*|[\"'`]",
}
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


@cache
def _master(lang: str) -> re.Pattern:
    return re.compile(f"(?m)(?P<x>{_MARK})|(?P<c>{_COMMENTS[lang]})|(?P<s>{_STRINGS[lang]})|(?P<w>{_WORDS[lang]})|(?P<n>{_NUMBER})|(?P<o>{_OPENERS[lang]})|(?P<p>{_OPS[lang]})|(?P<e>[^\\s\\\\\\ufeff]|\\\\(?![\\n\\r]))")


def language_of(path: str | None) -> str | None:
    name = (path or "").rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def decode(content: bytes | None) -> str | None:
    """The text of a file without its byte-order mark; None if it is no UTF-8."""
    try:
        return (content or b"").decode("utf-8-sig")
    except UnicodeDecodeError:
        return None


def lex(text: str, lang: str, state: str = CODE, markup: bool = False) -> tuple[list[tuple[str, int, int]], str]:
    """The tokens of a text that is entered in a state, and the state at its end.

    With `markup` an element may stand where an operand may (JSX): it gives a string token and,
    like a template, `${` and `}` around each expression in it. A closing tag that closes nothing,
    attributes and texts that no element can have give tokens `e`.

    At the end of a file any state but CODE (and a line comment) is an error. A string that ends
    with its line without being closed gives a token `e`.
    """
    out: list[tuple[str, int, int]] = []
    pos, n = 0, len(text)
    js = lang in ("javascript", "typescript")
    stack: list[str] = []
    if state == IN_TEMPLATE:
        stack = ["${"]
    elif state != CODE:
        if js and state == "`":
            pos = _template(text, 0, out, stack)
            if pos < 0:
                return out, state
        else:
            m = _END[state].match(text)
            if not m:
                return out, _in_regex(text, state == "/[") if state in ("/", "/[") else state
            pos = m.end()
            if state in ('"', "'") and text[pos - 1 : pos] != state:
                out.append(("e", pos, pos))
    master = _master(lang)
    while pos < n:
        again = False
        for m in master.finditer(text, pos):
            k = m.lastgroup
            if k == "p":
                t = m.group()
                if js:
                    if t == "/" or t == "/=":
                        if not out or _no_operand(text, out):
                            r = _REGEX.match(text, m.start())
                            if r:
                                out.append(("r", m.start(), r.end()))
                                pos, again = r.end(), True
                                break
                            if not re.search(r"[\n\r]", text[m.end() :]):  # it goes on behind the text
                                return out, _in_regex(text[m.start() + 1 :], False)
                    elif t == "{":
                        stack.append("{")
                    elif t == "}" and stack:
                        opened = stack.pop()
                        if opened in ("${", "{<"):
                            out.append(("}", m.start(), m.end()))
                            if opened == "{<":
                                pos = _markup(text, m.end(), out, stack)
                                if pos < 0:
                                    return out, IN_MARKUP
                            else:
                                pos = _template(text, m.end(), out, stack)
                                if pos < 0:
                                    return out, "`"
                            again = True
                            break
                    elif t == "<" and markup and (not out or _no_operand(text, out) or text[out[-1][1] : out[-1][2]] == "default"):
                        tag = _TAG.match(text, m.start())
                        if tag and not (lang == "typescript" and _generic(text, tag)):
                            out.append(("s", tag.start(), tag.end()))
                            stack.append("<" + (tag[1] or ""))
                            pos = _markup(text, tag.end(), out, stack)
                            if pos < 0:
                                return out, IN_MARKUP
                            again = True
                            break
                out.append((t, m.start(), m.end()))
            elif k == "o":
                t = m.group()
                if js and t == "`":
                    out.append(("s", m.start(), m.end()))
                    pos = _template(text, m.end(), out, stack)
                    if pos < 0:
                        return out, "`"
                    again = True
                    break
                if t == "'" or t.endswith('"') and t != '"""' and "@" not in t:
                    end = re.compile(r"[\n\r]|\Z").search(text, m.end()).start()
                    if end == n:
                        return out, t[-1]
                    out.append(("e", m.start(), end))
                    pos, again = end, True
                    break
                return out, '@"' if "@" in t else t
            else:
                out.append((k, m.start(), m.end()))
        if not again:
            break
    if out and out[-1][0] == "c" and out[-1][2] == n and not text.startswith("/*", out[-1][1]):
        return out, LINE
    if any(x[0] in "<>" or x == "{<" for x in stack):
        return out, IN_MARKUP
    return out, IN_TEMPLATE if "${" in stack else CODE


_NAME = r"[A-Za-z_$][\w$.:-]*"
_TAG = re.compile(rf"<\s*(?:({_NAME})|(?=>))")
_IN_TAG = re.compile(rf"\s+|=|{_NAME}|\"[^\"]*\"|'[^']*'|/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*")
_END_TAG = re.compile(rf"</\s*({_NAME})?\s*>")


def _generic(text: str, tag: re.Match) -> bool:
    """Whether `<T` begins type parameters of a function rather than an element."""
    rest = text[tag.end() : tag.end() + 200]
    return bool(re.match(r"\s*,|\s+extends\b(?!\s*=)", rest) or re.match(r"[\w\s,]*>\s*\(", rest) and f"</{tag[1]}" not in text[tag.end() :])


def _markup(text: str, pos: int, out: list, stack: list) -> int:
    """Go on in an element, whose tag ("<name") or content (">name") is on top of the stack: to behind its end or behind `{`; -1 if the text ends before."""
    n = len(text)
    while stack and stack[-1][0] in "<>":
        if pos >= n:
            return -1
        name = stack[-1][1:]
        c = text[pos]
        if stack[-1][0] == "<":
            m = _IN_TAG.match(text, pos)
            if m:
                pos = m.end()
            elif text.startswith("/>", pos):
                stack.pop()
                pos += 2
            elif c == ">":
                stack[-1] = ">" + name
                pos += 1
            elif c == "{":
                break
            elif c == "<" and _TAG.match(text, pos):  # an element as the value of an attribute
                m = _TAG.match(text, pos)
                stack.append("<" + (m[1] or ""))
                pos = m.end()
            elif c in "\"'":
                return -1
            else:
                out.append(("e", pos, pos + 1))
                pos += 1
        elif c == "{":
            break
        elif c == "<":
            m = _END_TAG.match(text, pos)
            if m:
                if (m[1] or "") != name:
                    out.append(("e", pos, m.end()))
                stack.pop()
                pos = m.end()
            elif _TAG.match(text, pos):
                m = _TAG.match(text, pos)
                stack.append("<" + (m[1] or ""))
                pos = m.end()
            else:
                out.append(("e", pos, pos + 1))
                pos += 1
        else:
            end = re.compile(r"[{<]|\Z").search(text, pos).start()
            if re.search(r"[>}]", text[pos:end]) or _CONFLICTS.search(text, pos, end):
                out.append(("x" if _CONFLICTS.search(text, pos, end) else "e", pos, end))
            pos = end
    if stack and stack[-1][0] in "<>":
        stack.append("{<")
        out.append(("${", pos, pos + 1))
        pos += 1
    return pos


def _in_regex(text: str, in_class: bool) -> str:
    """The state at the end of a text that lies within a regular expression."""
    for m in re.finditer(r"\\.|[\[\]]", text):
        in_class = m.group() == "[" or in_class and m.group() != "]"
    return "/[" if in_class else "/"


def _template(text: str, pos: int, out: list, stack: list) -> int:
    """Go on in a template string: to behind its end or behind `${`; -1 if the text ends before."""
    end = _TEMPLATE.match(text, pos).end()
    if end >= len(text):
        return -1
    if text[end] == "`":
        return end + 1
    stack.append("${")
    out.append(("${", end, end + 2))
    return end + 2


def _no_operand(text: str, out: list) -> bool:
    """Whether what stands before a slash is no operand, so that a regular expression begins."""
    for k, a, b in reversed(out):
        if k == "c":
            continue
        if k == "w":
            return text[a:b] in _BEFORE_REGEX
        return k not in ("n", "s", "r", ")", "]", "}")
    return True


PAIRS = {")": "(", "]": "[", "}": "{"}


def brackets(tokens: list[tuple[str, int, int]]) -> tuple[str, str, bool]:
    """Unmatched closing brackets, unmatched opening ones, and whether two don't fit."""
    shut, opened = [], []
    for k, _, _ in tokens:
        if k in "([{" or k == "${":
            opened.append(k[-1])
        elif k in ")]}":
            if not opened:
                shut.append(k)
            elif opened.pop() != PAIRS[k]:
                return "".join(shut), "".join(opened), True
    return "".join(shut), "".join(opened), False


def join_brackets(left: tuple[str, str, bool], right: tuple[str, str, bool]) -> tuple[str, str, bool]:
    """The summary of two texts one after the other; associative."""
    if left[2] or right[2]:
        return "", "", True
    opened, shut = left[1], right[0]
    k = min(len(opened), len(shut))
    if any(PAIRS[c] != o for c, o in zip(shut[:k], reversed(opened))):
        return "", "", True
    return left[0] + shut[k:], opened[: len(opened) - k] + right[1], False
