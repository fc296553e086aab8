"""One form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata as ud
from functools import cache

#: Letters of other scripts that look like a Latin one.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜӀаеѕіјорсухһԁԛԝӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲ" + "ՕՍօսցհո" + "Ꭰ Ꭱ Ꭲ Ꭺ Ꭻ Ꭼ Ꮃ Ꮇ Ꮋ Ꮐ Ꮓ Ꮤ Ꮥ Ꮩ Ꮪ Ꮮ Ꮯ Ꮲ Ꮶ Ᏼ".replace(" ", ""),
        "ABESIJKMHOPCTYXYGQWIaesijopcyxhdqwl" + "ABEZHIKMNOPTYXCjoc" + "OUoughn" + "D R T A J E W M H G Z W S V S L C P K B".replace(" ", ""),
        strict=True,
    )
)
LOOKALIKES["µ"] = "μ"

#: Code points that show nothing (default ignorable ones, and controls but tab and line ends).
_INVISIBLE = (
    "\\0-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f\\xad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180f\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f"
    "\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0\\ufff0-\\ufff8\\U0001bca0-\\U0001bca3\\U0001d173-\\U0001d17a\\U000e0000-\\U000e0fff"
)
_LINE_ENDS = "\x0b\x0c\x85\u2028\u2029"
_PICTURE = "\\xa9\\xae\\u203c\\u2049\\u2122\\u2139\\u2194-\\u21ff\\u2300-\\u23ff\\u2460-\\u24ff\\u25a0-\\u27bf\\u2900-\\u297f\\u2b00-\\u2bff\\u3030\\u303d\\u3297\\u3299\\U0001f000-\\U0001faff"
_VIRAMA = "\\u094d\\u09cd\\u0a4d\\u0acd\\u0b4d\\u0bcd\\u0c4d\\u0ccd\\u0d4d\\u0dca\\u1039\\u17d2"
_JOINERS = re.compile(
    f"(?<=[{_PICTURE}])([\\ufe0e\\ufe0f]?)\\u200d(?=[{_PICTURE}])"  # one picture of several
    f"|(?<=[{_VIRAMA}])[\\u200c\\u200d]"  # behind a virama
    "|(?<=[\\u0620-\\u06ff])[\\u200c\\u200d](?=[\\u0620-\\u06ff])"  # between joining letters
)
_KEPT = {"\u200d": "\ufdd0", "\u200c": "\ufdd1"}  # noncharacters for joiners that shape what is seen
_DROP = re.compile(f"[{_INVISIBLE}]")


def _letter(c: str) -> str:
    """The form of one code point, before composition."""
    d = ud.decomposition(c)
    if d.startswith(("<wide>", "<narrow>")):
        c = "".join(chr(int(x, 16)) for x in d.split()[1:])
    if ud.category(c) == "Zs":
        c = " "
    return "".join(LOOKALIKES.get(x, x) for x in ud.normalize("NFD", c))


@cache
def _unstable() -> re.Pattern:
    """A character that may change, by its quick-check property, with what it may join.

    Stable are code points that are their own form and, by NFC_Quick_Check, never compose with
    what stands before. A segment is a run of others with the stable one before it.
    """
    points, start = [], None
    spans = ((0x80, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))  # elsewhere are only ideographs, syllables and free points
    for o in (o for a, z in spans for o in range(a, z + 1)):
        c = chr(o) if all(o != z for _, z in spans) else ""
        # NFC_Quick_Check is Maybe or No for combining marks and the later letters of a syllable
        bad = bool(c) and (ud.combining(c) != 0 or 0x1161 <= o <= 0x1175 or 0x11A8 <= o <= 0x11C2 or ud.normalize("NFC", _letter(c)) != c)
        if bad and start is None:
            start = o
        elif not bad and start is not None:
            points.append((start, o - 1))
            start = None
    u = "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in points)
    return re.compile(f"[^{u}]?[{u}]+")


_BLANKS = {ord("\t"): " ", **{ord(c): "\n" for c in _LINE_ENDS}}
_PLAIN = re.compile(r"[\x20-\x7e\n]*")


def canonical(text: str | None) -> str | None:
    """The form that texts share exactly if they look the same to a reader.

    No differences: width of letters, digits and signs, kinds of spaces and of line ends, blanks
    at line ends, invisible characters, the composition of accents, and look-alike letters of
    other scripts. Kept: accents, letter case, raised, circled and fraction signs, pictures joined
    to one, joiners that shape a letter, the number of spaces, any other sign.

    Null stays null. Unchanged stretches are copied; only unstable segments, with the character
    before each, are decomposed, mapped and composed again. Idempotent.
    """
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return _ends(text)
    if "\u200d" in text or "\u200c" in text:
        text = _JOINERS.sub(lambda m: _KEPT[m.group()[-1]], text)
    text = _DROP.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = text.translate(_BLANKS)
    if not text.isascii():
        text = _unstable().sub(lambda m: ud.normalize("NFC", "".join(map(_letter, m.group()))), text)
    for joiner, kept in _KEPT.items():
        text = text.replace(kept, joiner)
    return _ends(text)


def _ends(text: str) -> str:
    """Without blanks at line ends and empty space at both ends, which nobody sees."""
    return re.sub(r" +(?=\n|\Z)", "", text).strip("\n").rstrip() if " \n" in text or text[-1:] in " \n" or text[:1] == "\n" else text
