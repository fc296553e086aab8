"""Local grammars: whether balanced source text consists of statements of its language.

Tokens become letters, a closed bracket group becomes one letter, and each statement of a block is
a short string of letters that a regular expression must match. A group is judged once, when it
closes, by the place it stands in; nothing looks further than one statement.

Letters: w word, n number, s string, r regular expression, P B C K groups in parentheses, square
brackets, braces with a value and braces with statements or members, o binary operator, u plus or
minus, p prefix operator, i increment, = assignment, A arrow, d dots, G type arguments.
Keywords have letters of their own.
"""

from __future__ import annotations

import ast
import re
import warnings

from graphloom.ingest.lexing import CODE, LINE, brackets, lex

BLOCK, TYPE, MEMBERS, VALUE, PAREN, SQUARE, FREE = "block", "top", "members", "value", "paren", "square", "free"


def _words(**kinds: str) -> dict[str, str]:
    return {w: k for k, ws in kinds.items() for w in ws.split()}


_FLOW = {"R": "return throw", "F": "if while", "O": "for", "E": "else", "D": "do", "T": "try finally", "H": "catch", "S": "switch", "Q": "case", "q": "default", "J": "break continue", "N": "new"}
KEYWORDS = {
    "javascript": _words(**_FLOW, f="function", v="const let var", c="class", I="import", X="export", y="typeof void delete await yield", o="in instanceof", x="extends", h="enum") | {"with": "F", "debugger": "J"},
    "java": _words(**_FLOW, k="package", I="import", c="class interface enum", x="extends implements throws", o="instanceof", M="public private protected static final abstract native synchronized transient volatile strictfp") | {"assert": "R"},
    "csharp": _words(
        **_FLOW, U="using", k="namespace", c="class struct interface enum", o="is as", M="public private protected internal static readonly const sealed abstract virtual override extern unsafe volatile ref out in params event implicit explicit",
    ) | {"lock": "F", "fixed": "F", "foreach": "O", "checked": "T", "goto": "J"},
    "go": _words(k="package", I="import", f="func", v="var const", t="type", z="struct interface", m="map", h="chan", R="return", F="if", O="for", E="else", S="switch select", y="go defer range", Q="case", q="default", J="break continue goto fallthrough"),
}
KEYWORDS["typescript"] = KEYWORDS["javascript"]

_OPS = {"+": "u", "-": "u", "!": "p", "~": "p", "++": "i", "--": "i", "=>": "A", "->": "A", "...": "d", "?.": ".", "::": ".", ":=": "=", "..": "o", "<-": "l"}
_ASSIGN = re.compile(r"(?:[-+*/%&|^]|<<|>>>?|\*\*|&&|\|\||\?\?|&\^)?=")


def _letter(t: str) -> str:
    return _OPS.get(t) or ("=" if _ASSIGN.fullmatch(t) else t if t in ".,:;?@<>*&" else "o")


# Expressions. Possessive repeats keep long tables linear.
_GEN = r"<[w.,?<>x&B@oCPsn:|RyvM]*?[>o]"
_TS_GEN = r"<w(?:x[w.<>|&Bs]+)?(?:,w(?:x[w.<>|&Bs]+)?)*,?>(?=P)"
_JS_T = r"(?:[puiyNd*]|<)*+(?:f\*?w?(?:<[w,x]*>)?P(?::[w.B<>,]+)?K|cw?(?:xw(?:\.w)*)?K|[wnsrPBCI])(?:\.[wPB]|[PBsi])*+"
_JS_E = rf"{_JS_T}(?:AK|(?:[ou*=?:,A<>&]|,(?=$)|[<>]+[=P])(?:(?<=,)$|{_JS_T}))*+,?"
_TS_T = rf"(?:{_TS_GEN})?(?:[puiyNd*]|<)*+(?:f\*?w?(?:<[w,x]*>)?P(?::[w.B<>,]+)?K|cw?(?:xw(?:\.w)*)?K|[wnsrPBCI])(?:{_GEN}(?=[PA=,]|\Z)|\.[wPB]|[PBsip])*+"
_TS_TYPE = r"[w.nsPBCo&<>,Ay?u:|]+?"
_TS_E = rf"{_TS_T}(?:AK|[ou*=?:,A<>&](?:(?<=,)$|{_TS_T}))*+,?"
_C_TYPE = rf"w(?:\.w)*(?:{_GEN})?(?:\.w(?:{_GEN})?)*[B?]*"
_C_T = rf"(?:[puiyNl*&]|M(?=[wPN])|P(?=[wnsNpP]))*+(?:[wnsPBCS])(?:{_GEN}(?=[P.B])|\.(?:[wN]|{_GEN})|BC?|PK?|C|[ip])*+"
_C_E = rf"{_C_T}(?:AK|(?:[ou*=?:,A<>&]|A?R)(?:(?<=,)$|{_C_T}))*+,?"
_GO_TYPE = r"(?:[*&]|B|mB|h|l|d)*(?:w(?:\.w)?B?|zC|fP(?:[*B]*w(?:\.w)?|P)?|P)"
_GO_T = rf"(?:[*&pulyo]|B(?=[wmfzB*h])|mB|h)*+(?:fP(?:{_GO_TYPE})?K|zC|[wnsPBCm])(?:\.[wPB]|[PBC])*+"
_GO_E = rf"{_GO_T}(?:[ou*=:,<>&l](?:(?<=,)$|{_GO_T}))*+[,id]?"
_ANN = r"(?:@w(?:\.w)*P?)*"
_JAVA_DECL = rf"(?:{_ANN}M)*{_ANN}{_C_TYPE}d?wB*(?:=§)?(?:,wB*(?:=§)?)*"


_JS_STMT = [
    r";", r"§;?", r"vD(?:,D)*;?".replace("D", r"(?:w|B|C)(?:=§)?"), r"X?q?f\*?w?PK", r"X?q?cw?(?:x§)?K", r"Xv(?:w|B|C)(?:=§)?(?:,w(?:=§)?)*;?", r"Xq§;?", r"XC(?:ws)?;?", r"X\*(?:ww)?ws;?",
    r"I(?:s|w?Cws|w(?:,C)?ws|w?(?:,?\*ww)ws)(?:wC)?;?", r"R§?;?|R;?", r"Jw?;?", r"Q§:", r"q:", r"w:", r"K", r"[ED]", r"[FO]w?P", r"HP?K?", r"T", r"SPK",
]
_TS_DECL = rf"(?:w|B|C)p?(?::{_TS_TYPE})?(?:=§)?"
_TS_STMT = _JS_STMT + [
    rf"X?q?w*f\*?w?(?:{_GEN})?P(?::{_TS_TYPE})?K", rf"X?w*v{_TS_DECL}(?:,{_TS_DECL})*;?", rf"X?q?w*cw?(?:{_GEN})?(?:x{_TS_TYPE})?(?:w{_TS_TYPE})?K",
    rf"X?w*tw(?:{_GEN})?=o?{_TS_TYPE};?", rf"X?w*jw(?:{_GEN})?(?:x{_TS_TYPE})?C", r"X?w*(?:v)?hwC", r"X?w*g(?:w(?:\.w)*|s)K", r"X?=§;?", r"Iw=§;?", r"(?:@§)+",
]
_JAVA_TYPE_DECL = rf"(?:{_ANN}M)*{_ANN}@?cw(?:{_GEN})?P?(?:x{_C_TYPE}(?:,{_C_TYPE})*)*K"
_FLOW_STMT = [r";", r"§;", r"R§?;|R;", r"J(?:q|Q?§)?;", r"Q.*:", r"q:", r"q?Q?.*A", r"w:", r"K", r"[ED]", r"[FO]w?P", r"HP?(?:wP)?", r"TP?", r"SPK", r"MPK?"]
_CS_ATTR = r"(?:B(?=[BMwcx]))*"
_CS_MODS = rf"{_CS_ATTR}M*(?:NM*)?"
_CS_DECL = rf"{_CS_MODS}(?:{_C_TYPE}|P[B?]*)w(?:=§)?(?:,w(?:=§)?)*"
_CS_WHERE = r"(?:x[^K;A]*)?"
_CS_TYPE_DECL = rf"{_CS_MODS}cc?w(?:{_GEN})?P?(?::{_C_TYPE}P?(?:,{_C_TYPE})*)?{_CS_WHERE}(?:K;?|C;?|;)"
STATEMENTS = {
    "javascript": {TYPE: _JS_STMT, BLOCK: _JS_STMT, MEMBERS: [r";", r"w{0,3}\*?(?:w|s|n|B)PK", r"w{0,2}(?:w|s|n|B)(?:=§)?;?", r"wK", r"(?:@§)+"]},
    "typescript": {
        TYPE: _TS_STMT, BLOCK: _TS_STMT,
        MEMBERS: [r";", rf"[wc]{{0,5}}\*?(?:w|s|n|B)p?(?:{_GEN})?P(?::{_TS_TYPE})?(?:K|;?)", rf"w{{0,5}}(?:w|s|n|B)p?(?::{_TS_TYPE})?(?:=§)?;?", r"wK", r"(?:@§)+"],
    },
    "java": {
        TYPE: [r";", rf"{_ANN}kw(?:\.w)*;", r"IM?w(?:\.w)*(?:\.\*)?;", _JAVA_TYPE_DECL],
        BLOCK: [*[p if p[0] != "J" else r"Jw?;" for p in _FLOW_STMT], rf"{_JAVA_DECL};", _JAVA_TYPE_DECL],
        MEMBERS: [
            r";", rf"(?:{_ANN}[Mq])*{_ANN}(?:{_GEN})?{_C_TYPE}wPB*(?:x{_C_TYPE}(?:,{_C_TYPE})*)?(?:K|(?:q§)?;)", rf"(?:{_ANN}M)*{_ANN}(?:{_GEN})?W(?:P)?(?:x{_C_TYPE}(?:,{_C_TYPE})*)?K", rf"{_JAVA_DECL};", _JAVA_TYPE_DECL, r"M*K",
        ],
    },
    "csharp": {
        TYPE: [r"MU.*;|U[MN]?w(?:\.w)*(?:=.*)?;", r"Bk?", r"kw(?:\.w)*(?:K|;)", _CS_TYPE_DECL, *_FLOW_STMT, rf"U?{_CS_DECL};", rf"{_CS_MODS}{_C_TYPE}w(?:{_GEN})?P{_CS_WHERE}(?:K|A§;)"],
        BLOCK: [*_FLOW_STMT, rf"U?{_CS_DECL};", r"UP", rf"{_CS_MODS}{_C_TYPE}w(?:{_GEN})?P{_CS_WHERE}(?:K|A§;)", rf"M*{_C_TYPE}\*w=§;"],
        MEMBERS: [
            r";", rf"{_CS_MODS}(?:{_C_TYPE}|P[B?]*)[wW](?:\.w)*(?:{_GEN})?P{_CS_WHERE}(?:K|A§;|;)", rf"{_CS_MODS}p?WP(?::wP)?(?:K|A§;|;)", rf"{_CS_MODS}(?:{_C_TYPE}|P[B?]*)w(?:\.w)*B?(?:[CK](?:=§;)?|A§;)", rf"{_CS_DECL};", _CS_TYPE_DECL,
            rf"{_CS_MODS}w?{_C_TYPE}w(?:{_GEN})?P;", rf"{_CS_MODS}.*w[ou*p<>=&i]+P(?:K|A§;)", rf"(?:M*w(?:;|K|A§;))",
        ],
    },
    "go": {
        TYPE: [r";", r"kw", r"I(?:[w.]?s|P)", rf"fP?wB?P(?:{_GO_TYPE})?K?", r"v(?:P|¤)", r"t(?:P|wB?=?¥)", r"x"],
        BLOCK: [r"", r"§", r"R§?", r"Jw?", r"Q.*:", r"q:", r"w:", r"v(?:P|¤)", r"t(?:P|wB?=?¥)", r"K", r"(?:E?F(?:§?;)?§|E|O(?:§?;§?;(?:§)?|§)?|S(?:§?;)?(?:§)?)K", r"SC"],
    },
}
_GO_VAR = rf"w(?:,w)*(?:{_GO_TYPE})?(?:=§)?"
_EXPR = {"javascript": _JS_E, "typescript": _TS_E, "java": _C_E, "csharp": _C_E, "go": _GO_E}
_PARENS = {
    "javascript": r"(?:v?§)?(?:;(?:§)?;(?:§)?)?",
    "typescript": rf"(?:v?w{{0,2}}{_TS_DECL}(?:,w{{0,2}}d?{_TS_DECL})*,?)|(?:v?w?d?(?:§|{_TS_DECL})(?:,w?d?{_TS_DECL})*,?)?(?:;(?:§)?;(?:§)?)?|d.*",
    "java": rf"(?:(?:{_JAVA_DECL}|§)(?:[;:,](?:{_JAVA_DECL}|§)?)*)?|;.*|M*{_C_TYPE}(?:o{_C_TYPE})+w",
    # the last alternative takes patterns and queries, but no two values side by side and no three words as a parameter
    "csharp": rf"(?:(?:{_CS_ATTR}M*(?:{_CS_DECL}|§|{_C_TYPE}))(?:[;:,]{_CS_ATTR}M*(?:{_CS_DECL}|§)?|Mw?§|o§)*)?|;.*|(?!.*[nsr][nsrw]|.*w[ns]|(?:.*,)?M*www)(?:[MB]*.*)",
    "go": rf"(?:[w.]?s(?:;+[w.]?s)*;*)?|¤(?:;+¤)*;*|wB?=?¥(?:;+wB?=?¥)*;*|t|§?|(?:w,)*w?d?¥(?:,(?:w,)*w?d?¥)*,?",
}


def _compile(lang: str) -> tuple[dict[str, re.Pattern], re.Pattern, re.Pattern]:
    e = f"(?:{_EXPR[lang]})"
    whole = lambda ps: re.compile("(?:" + "|".join(f"(?:{p})" for p in ps).replace("¤", _GO_VAR).replace("¥", _GO_TYPE).replace("§", e) + r")\Z")
    return {k: whole(v) for k, v in STATEMENTS[lang].items()}, whole([_PARENS[lang]]), whole(["§", "", r"w\??:§"])


_COMPILED = {lang: _compile(lang) for lang in _EXPR}
_ENUM = {"java": re.compile(rf"(?:{_ANN}wP?K?(?:,{_ANN}wP?K?)*,?)?;?Z?\Z"), "csharp": re.compile(rf"{_CS_ATTR}w(?:={_C_E})?(?:,{_CS_ATTR}w(?:={_C_E})?)*,?Z\Z")}
_ENDS_OPERAND = frozenset("wWnsrPBCKiJRp")
_STARTS = frozenset("wnsr")
_TS_MODIFIERS = frozenset("readonly get set type static async declare asserts".split())


class _Frame:
    __slots__ = ("kind", "buf", "owner", "held", "colons", "first", "enum", "ifs")

    def __init__(self, kind: str, owner: str | None = None):
        self.kind, self.owner, self.buf, self.held, self.colons, self.first, self.enum, self.ifs = kind, owner, "", False, 0, True, False, 0


def _brace(lang: str, f: _Frame, names: list[str]) -> tuple[str, str]:
    """What a brace opens, and the letter of the group."""
    b = f.buf
    last = b[-1:]
    in_statements = f.kind in (BLOCK, TYPE)
    if lang == "go":
        if f.kind in (PAREN, SQUARE, VALUE):
            return (BLOCK, "K") if re.search(rf"f(?:P|P{_GO_TYPE})\Z", b) else (VALUE, "C")
        if not b:
            return BLOCK, "K"
        if last == "z":
            return FREE, "C"
        if re.search(rf"fP(?:{_GO_TYPE})?\Z", b) or re.match(rf"fP?wB?P(?:{_GO_TYPE})?\Z", b):
            return BLOCK, "K"
        if b[0] in "FOSE":
            return (VALUE, "C") if re.search(r"(?:B|mB)[*]*w(?:\.w)?\Z", b) and "=" in b and b.count("y") else (BLOCK, "K")
        return VALUE, "C"
    if re.search(r"c(?:[wW]|\Z)[^=]*\Z", b) and f.kind in (BLOCK, TYPE, MEMBERS, VALUE, PAREN) and not re.search(r"c[^PK]*P[^:x]*A\Z", b) and last not in "=(":
        return MEMBERS, "K"
    if last == "A" or last in ("E", "D", "T", "H"):
        return BLOCK, "K"
    if lang in ("javascript", "typescript"):
        if re.match(r"[IX]q?w?,?\Z|X?w*j|X?w*v?hw\Z|I.*wsw\Z", b):
            return FREE, "C"
        if re.match(r"X?w*g", b):
            return BLOCK, "K"
        if last == "P" or re.search(r"(?:f\*?w?(?:<[^>]*>)?|[wsnB]|\A\w*)P:[^=?]*(?:[wB>nsC]|<[^<>=]*<[^<>=]*o)\Z", b) and (f.kind == MEMBERS or "f" in b):
            return BLOCK, "K"
        if not b and in_statements or f.kind == MEMBERS and last == "w" and b == "w":
            return BLOCK, "K"
        return VALUE, "C"
    if last == "P":
        if re.search(r"(?:[=,RAyo?:.]|^)N[w.<>,o]*P\Z", b):
            return (MEMBERS, "K") if lang == "java" else (VALUE, "C")
        return BLOCK, "K"
    if lang == "java" and f.kind == MEMBERS and re.fullmatch(r"(?:wP?K?,)*w", b):
        return MEMBERS, "K"
    if lang == "csharp":
        if re.match(r"kw(?:\.w)*\Z", b):
            return TYPE, "K"
        if f.kind == MEMBERS and last in ("w", "B") and "=" not in b:
            return FREE, "C"
        if last == "S" or re.search(r"x[^K;A]*\Z", b) and last != "=":
            return (FREE, "C") if last == "S" else (BLOCK, "K")
    if not b and f.kind in (BLOCK, TYPE, MEMBERS) or re.match(r"M+\Z", b) and f.kind == MEMBERS:
        return BLOCK, "K"
    if re.search(r"x[^=]*\Z", b) and f.kind == MEMBERS:
        return BLOCK, "K"
    return VALUE, "C"


def statements_fit(text: str, tokens: list[tuple[str, int, int]], lang: str, first: bool = True) -> str | None:
    """None if balanced tokens are statements of the language, else what is wrong first.

    `first` tells whether the text begins its file (with the package clause in Go).
    """
    kws, (rules, paren, square) = KEYWORDS[lang], _COMPILED[lang]
    js, go = lang in ("javascript", "typescript"), lang == "go"
    toks = [t for t in tokens if t[0] != "c"]
    top = _Frame(TYPE)
    top.first = first
    stack = [top]
    end = 0
    count = len(toks)
    names: list[str] = []
    enums = [False]

    def flush(f: _Frame) -> bool:
        b, f.buf = f.buf, ""
        if not b:
            return True
        held, f.held = f.held, False
        if f.kind not in (BLOCK, TYPE, MEMBERS):
            return True
        if f.kind == TYPE and go:
            ok = (b == "kw") if f.first else b != "kw" and rules[TYPE].match(b)
            f.first = False
            return bool(ok)
        if not go and f.kind != MEMBERS:  # an else needs an if that has none yet
            if b == "E":
                if not f.ifs:
                    return False
                f.ifs -= 1
            elif not held:
                f.ifs = 0
            if b == "FP":
                f.ifs += 1
        if not rules[f.kind].match(b) and not (f.enum and lang in _ENUM and _ENUM[lang].match(b)):
            return False
        if js and b.count(":") > b.count("?") and b[-1] != ":":
            if lang == "javascript" or re.search(r"(?:^|=)[^=]*$", b) and f.kind != MEMBERS and not re.search(r"[fvjthc]|A", b):
                return False
            if lang == "typescript" and re.match(r"X?v", b) and re.search(r"=[^A?]*:[^A?]*$", b):
                return False
        if re.fullmatch(r"[FO]w?P|[ED]|T|TP|UP|HP?(?:wP)?", b):
            f.held = True
        return True

    for i, (k, a, z) in enumerate(toks):
        f = stack[-1]
        b = f.buf
        if k in ("x", "e"):
            return "conflict marker" if k == "x" else "no token"
        line_break = (f.kind in (BLOCK, TYPE, MEMBERS) or go and f.kind in (PAREN, FREE)) and b and "\n" in text[end:a] or False
        end = z
        if k == "w":
            word = text[a:z]
            c = kws.get(word, "w")
            if b[-1:] == "." and c != "w":
                c = "w"
            nxt = toks[i + 1] if i + 1 < count else ("", 0, 0)
            if js:
                if f.kind == VALUE and c != "w" and nxt[0] in (":", ",", "}", "(") and b[-1:] in ("", ",") and c != "f":
                    c = "w"
                elif f.kind == MEMBERS and c != "w" and nxt[0] in ("(", "=", ";", "?", ":", "}"):
                    c = "w"
                elif c == "q" and b and b[-1] != "X":
                    c = "w"
                elif word == "async" and (nxt[0] in ("w", "(", "[", "*")) and "\n" not in text[z : nxt[1]]:
                    continue
                elif word == "of" and f.kind == PAREN and b[-1:] in ("w", "B", "C") and b[:1] in ("v", "w"):
                    c = "o"
                elif c == "I" and nxt[0] in ("(", "."):
                    c = "w"
                elif lang == "typescript":
                    if word == "void" and nxt[0] not in ("n", "w"):
                        c = "w"
                    elif word in ("as", "satisfies", "is") and b[-1:] in ("w", "P", "B", "C", "n", "s") and nxt[0] in ("w", "{", "s", "[", "("):
                        c = "o"
                    elif word in ("keyof", "readonly", "infer", "unique", "asserts") and nxt[0] in ("w", "[", "("):
                        continue
                    elif nxt[0] in ("w", "s") and re.fullmatch(r"X?w*", b) and f.kind in (BLOCK, TYPE):
                        c = {"interface": "j", "type": "t", "namespace": "g", "module": "g"}.get(word, c) if "\n" not in text[z : nxt[1]] else c
            elif lang in ("java", "csharp"):
                n2 = toks[i + 2][0] if i + 2 < count else ""
                if word == "record" and nxt[0] == "w" and n2 in ("(", "{", "<", ":", ";") and re.fullmatch(r"[MBP@w]*", b) and f.kind in (BLOCK, TYPE, MEMBERS) and (b == "" or b[-1] == "M" or n2 in "({"):
                    c = "c"
                elif lang == "java":
                    if word in ("sealed",) and nxt[0] == "w" and text[nxt[1] : nxt[2]] in ("class", "interface", "abstract"):
                        c = "M"
                    elif word == "permits" and "c" in b:
                        c = "x"
                    elif word == "yield" and nxt[0] in ("w", "n", "s") and not b:
                        c = "R"
                    elif c == "c" and b[-1:] == ".":
                        c = "w"
                elif c == "q" and nxt[0] != ":":
                    c = "w"
                elif word in ("async", "partial", "required", "file", "scoped") and nxt[0] in ("w", "("):
                    if nxt[0] == "w":
                        c = "M"
                    else:
                        continue
                elif word == "await" and nxt[0] in ("w", "("):
                    c = "y"
                elif word == "yield" and nxt[0] == "w":
                    continue
                elif word == "where" and nxt[0] == "w" and n2 == ":":
                    c = "x"
                elif lang == "csharp" and word == "not" and b[-1:] == "o" or word == "this" and f.kind == PAREN and nxt[0] == "w":
                    continue
                elif word in ("not", "and", "or", "when") and b and (b[-1] in "wnsPo"):
                    c = "o"
                if c == "w" and f.kind == MEMBERS and word == f.owner and nxt[0] == "(":
                    c = "W"
            if line_break and (go or js):
                if go and b[-1] in _ENDS_OPERAND or js and (b[-1] in _ENDS_OPERAND and b[-1] != "p" or lang == "typescript" and b[-1] == "p") and c != "o" and not re.match(r"(?:[FO]w?|H)\Z", b):
                    if js and c in ("x",) or js and re.match(r"[IX]", b) and word == "from":
                        pass
                    elif go and f.kind in (PAREN, FREE):
                        f.buf += ";"
                    elif not flush(f):
                        return "statement"
            if lang == "typescript" and f.kind == FREE and c == "w" and b[-2:] == "ww" and i > 1 and "\n" not in text[toks[i - 2][1] : a] and text[toks[i - 2][1] : toks[i - 2][2]] not in _TS_MODIFIERS:
                return "statement"
            if c == "c" and nxt[0] == "w":
                names.append(text[nxt[1] : nxt[2]])
                enums[0] = word == "enum"
            f.buf += c
            if js and c in ("E", "D", "T") or lang in ("java", "csharp") and (c in ("E", "D") or c == "T" and nxt[0] != "("):
                if f.kind in (BLOCK, TYPE) and f.buf != c:
                    return "statement"
                if f.kind in (BLOCK, TYPE) and not flush(f):
                    return "statement"
            continue
        if k in ("n", "s", "r", "(", "[", "{", "${"):
            starts = k in ("n", "s", "r") or k == "{" or go
            if line_break and starts and b[-1] in _ENDS_OPERAND and (go or js):
                awaits = js and k == "{" and re.search(r"P\Z|c[^K]*\Z", b) or go and k == "{" and False
                if not awaits and not (js and k == "s" and text[a] == "`"):
                    if go and f.kind in (PAREN, FREE):
                        f.buf += ";"
                    elif not flush(f):
                        return "statement"
            if k in ("n", "s", "r"):
                f.buf += k
                continue
            if k == "(" or k == "${":
                stack.append(_Frame(PAREN if k == "(" else VALUE))
                stack[-1].owner = k
            elif k == "[":
                stack.append(_Frame(SQUARE))
            else:
                kind, letter = _brace(lang, f, names)
                child = _Frame(kind, names[-1] if kind == MEMBERS and names else None)
                child.colons = letter
                child.enum = kind == MEMBERS and enums[0] and bool(re.search(r"c[wW]", b))
                stack.append(child)
                f.held = f.held and bool(f.buf)
            continue
        if k in (")", "]", "}"):
            if len(stack) == 1:
                return "bracket"
            inner = stack.pop()
            f = stack[-1]
            tail = inner.buf
            if inner.kind in (BLOCK, TYPE, MEMBERS):
                if tail:
                    if inner.kind == MEMBERS and lang in ("java", "csharp") and not tail.endswith(";"):
                        inner.buf = tail + "Z"  # enum constants
                    if not js and not go and inner.kind == BLOCK:
                        return "statement"
                    if not flush(inner):
                        return "statement"
                if inner.held:
                    return "statement"
            elif inner.kind == PAREN:
                t = tail.rstrip(";") if go else tail
                if not paren.match(t):
                    return "parentheses"
                if lang == "javascript" and t.count(":") > t.count("?"):
                    return "parentheses"
            elif inner.kind == VALUE and not go:
                if inner.owner == "${" and tail and not square.match(tail) or inner.owner != "${" and not _value_fits(tail, lang):
                    return "braces"
            elif inner.kind == SQUARE and js and not square.match(re.sub(r"^,+|(?<=,),+", "", tail)) and lang == "javascript":
                return "square brackets"
            if inner.owner == "${" and k == "}":
                f.buf += "P"
                continue
            f.buf += "P" if k == ")" else "B" if k == "]" else inner.colons
            b = f.buf
            if f.kind in (BLOCK, TYPE, MEMBERS):
                if k == ")" and not go and re.fullmatch(r"[FO]w?P|HP?|UP|TP", b) and f.kind != MEMBERS:
                    nxt = toks[i + 1][0] if i + 1 < count else ""
                    if not (b == "HP" and lang == "csharp" and nxt == "w") and not flush(f):
                        return "statement"
                elif k == "}" and f.enum and lang == "java" and re.fullmatch(r"(?:wP?K?,)*wP?K", b):
                    continue
                elif k == "}" and f.buf[-1] == "K" and not go and _ends_with_block(b, lang, f.kind):
                    if lang == "csharp" and re.search(r"c.*K\Z", b) and i + 1 < count and toks[i + 1][0] == ";":
                        continue
                    if not flush(f):
                        return "statement"
                elif k == "}" and lang == "csharp" and f.kind == MEMBERS and b[-1] == "C" and "=" not in b and (i + 1 >= count or toks[i + 1][0] != "="):
                    if not flush(f):
                        return "statement"
                elif k == "}" and js and b[-1] == "C" and re.match(r"X?w*(?:j|v?h)", b) and not flush(f):
                    return "statement"
                elif k == "}" and go and b[-1] == "K" and re.match(r"[FOSE]", b) and i + 1 < count and text[toks[i + 1][1] : toks[i + 1][2]] == "else":
                    f.buf = ""
                elif k == "}" and go and b == "K" and not flush(f):
                    return "statement"
            continue
        c = _letter(k)
        if c == "?" and lang == "typescript" and i + 1 < count and toks[i + 1][0] in (":", ",", ")", "=", "("):
            continue
        if go and line_break and b[-1] in _ENDS_OPERAND:
            if f.kind in (PAREN, FREE):
                f.buf += ";"
            elif not flush(f):
                return "statement"
        elif js and line_break and (c == "i" or k in ("@", "!")) and b[-1] in _ENDS_OPERAND and not flush(f):
            return "statement"
        f.buf += c
        if f.kind in (BLOCK, TYPE, MEMBERS):
            if c == ";" and go and f.buf[0] in "FOS":
                continue
            if c == ";":
                if f.buf == ";" and f.held:
                    f.held, f.buf = False, ""
                if go:
                    f.buf = f.buf[:-1]
                if not flush(f):
                    return "statement"
            elif c == ":" and (f.buf[0] in "Qq" and f.buf.count("?") < f.buf.count(":") or f.buf == "w:") and f.kind != MEMBERS and not flush(f):
                return "statement"
    for f in stack[1:]:
        return "open bracket"
    if not js and not go and top.buf:
        return "end"
    if not flush(top):
        return "end"
    if top.held or go and top.first:
        return "end"
    return None


def _ends_with_block(b: str, lang: str, kind: str) -> bool:
    """Whether a statement ends with this block; else the block is part of an expression."""
    if b == "K" or kind == MEMBERS and not re.search(r"=", b):
        return True
    if lang in ("javascript", "typescript"):
        return bool(re.match(r"X?q?w*f\*?w|X?q?w*c|Xqf|[SFOHTD]|X?w*g", b)) and "=" not in re.sub(r"P", "", b[:4])
    return not re.search(r"[=RNA]", b) or bool(re.match(r"[SFOHT]", b)) and "=" not in b


def _value_fits(tail: str, lang: str) -> bool:
    """Object literals, initialisers and destructuring patterns."""
    if not tail:
        return True
    if lang in ("javascript", "typescript"):
        t = re.sub(r"(?:^|(?<=,))(?:w{0,2}\*?[wsnB]PK)(?=,|$)", "w", tail)
        t = re.sub(r"(?:^|(?<=,))w{0,2}\*?[wsnB](?:<[^>]*>)?P(?::[^K]*)?K(?=,|$)", "w", t)
        return bool(_COMPILED[lang][2].match(t)) or lang == "typescript" and bool(re.match(r"(?!.*:(?:[;,]|\Z))[wsnBPC:;,?.<>oAu&|y]*\Z", t))
    return bool(re.match(rf"(?:(?:{_C_E})|B=.*)\Z", tail))


#: Markup within an expression.
_MARKUP = re.compile(r"(?:\breturn|\bdefault|=>|[(=,?:]|&&|\|\|)\s*<(?:[A-Za-z][\w.]*)?[^;<>]*/?>")


def marked_up(text: str) -> bool:
    return ("</" in text or "/>" in text) and _MARKUP.search(text) is not None


def parses(text: str, lang: str, markup: bool = False) -> str | None:
    """None if the text is syntactically valid source of the language, else the first complaint.

    With `markup` the text may hold markup in expressions (JSX).
    """
    tokens, state = lex(text, lang, markup=markup and marked_up(text))
    if state not in (CODE, LINE):
        return "unterminated"
    if any(k in ("x", "e") for k, _, _ in tokens):
        return "conflict marker" if any(k == "x" for k, _, _ in tokens) else "no token"
    if brackets(tokens) != ("", "", False):
        return "bracket"
    return python_fits(text) if lang == "python" else statements_fit(text, tokens, lang)


def python_fits(text: str) -> str | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError):
        return "statement"
    except (RecursionError, MemoryError):
        return None
    return None
