"""What the documentation of a function says."""

from __future__ import annotations

import re

#: Words of grammar, words for documentation itself, and marks of what is still to be written.
GRAMMAR_WORDS = frozenset("a an the this that these it its is are be been of for to from and or in on with by as at some no not none null nil nothing self".split())
ABOUT_DOCS = frozenset(
    """function functions method methods procedure routine class helper util utility doc docs docstring documentation documented document comment comments description describe described descriptions summary remarks
    param params parameter parameters arg args argument arguments return returns returned raises throws type rtype value implement implemented implementation inherited inherits inherit inheritdoc undocumented""".split()
)
OPEN_MARKS = frozenset("todo fixme tbd tba xxx hack wip na n placeholder stub dummy missing internal lorem ipsum dolor auto autogenerated automatically generated here later soon yet goes coming fill obvious explanatory see above".split())
#: Words that state something, but not beside a word about documentation or a mark of what is to be written.
WEAK_WORDS = frozenset("add insert write below code source text follow follows come comes".split())
EMPTY_WORDS = GRAMMAR_WORDS | ABOUT_DOCS | OPEN_MARKS
_POINTER = re.compile(r"(?i)^\W*(?:(?:please )?(?:see|refer to|cf|same as|as in|identical to|documented (?:in|at)|described (?:in|at)|inherited|inherits|overrides?|copied from|delegates to|documentation (?:is )?(?:in|at))\b)[^.!?。]*(?:[.!?](?=\w)[^.!?。]*)*[.!?。]?\s*$")
_CONFLICT = re.compile(r"(?m)^(?:<{7}|>{7}|={7}|\|{7})(?: [^\n]*)?$")
_PARTS = re.compile(r"[^\W\d_]+|\d+")
_HUMPS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_a-zA-Z]+")


def plain(doc: str) -> str:
    """The text of a documentation comment without markers, tags and parameter names."""
    doc = _CONFLICT.sub("", doc)
    s = re.sub(r"\A[rRuU]*(?:\"\"\"|'''|\"|')|(?:\"\"\"|'''|\"|')\Z", "", doc) if doc[:1] in "rRuU\"'" else doc
    s = re.sub(r"(?m)^[ \t]*(?:/\*+|///?|\*+(?!/))|\*+/[ \t]*$", " ", s)
    s = re.sub(r"<(?:param|typeparam|paramref|typeparamref)\b[^>]*>|</?[a-zA-Z][^<>]*>", " ", s)
    s = re.sub(r"\{@\w+[^}]*\}", lambda m: " " if re.match(r"\{@inheritdoc", m.group(), re.I) else re.sub(r"\{@\w+|\}", " ", m.group()), s)
    s = re.sub(r"@(?:param|arg|argument|typeParam|throws|exception)\b(?:\s*\{[^}]*\})?[ \t]*[\w.$\[\]]*|@\w+", " ", s)
    s = re.sub(r":(?:param|type|arg|raises?|return|returns|rtype|keyword)\b[^:\n]*:", " ", s)
    return s.strip()


def _stem(w: str) -> str:
    for suffix in ("ies", "ying", "ied", "ys", "y"):
        if w.endswith(suffix) and len(w) > len(suffix) + 2:
            return w[: -len(suffix)] + "i"
    for suffix in ("ing", "ed", "es", "s", "e"):
        if w.endswith(suffix) and len(w) > len(suffix) + 2:
            return w[: -len(suffix)]
    return w


def _names(text: str) -> set[str]:
    return {_stem(h.lower()) for p in _PARTS.findall(text) for h in _HUMPS.findall(p)}


def says_something(doc: str | None, name: str, params: str) -> bool:
    """Whether a documentation has a statement beyond names, placeholders, tags and pointers."""
    if not doc:
        return False
    s = plain(doc)
    if not s or _POINTER.match(s) and len(s.split()) <= 12:
        return False
    known = _names(name) | _names(params)
    words = [p for p in _PARTS.findall(s) if not p.isdigit() and p.lower() not in GRAMMAR_WORDS]
    weak, empty = set(), False
    for p in words:
        if p.lower() in EMPTY_WORDS:
            empty = True
            continue
        for h in _HUMPS.findall(p) or [p]:
            h = h.lower()
            if h in WEAK_WORDS:
                weak.add(h)
            elif h not in EMPTY_WORDS and _stem(h) not in known:
                return True
    return len(weak) > 1 and not empty
