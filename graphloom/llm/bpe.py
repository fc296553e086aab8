"""Byte-level byte-pair encoding as a streaming transducer, and its inverse."""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import cache

import regex

#: Fixed value: how the public byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 1 << 18
FLUSH = 512
KEPT = 64  # characters of the longest piece that is kept


class ByteBpe:
    """A vocabulary of byte strings with ranks that are their ids.

    A piece's encoding is the one sequence of tokens in which every adjacent pair, and every
    token alone, encodes to itself. So the last token of every prefix follows from the last tokens
    of shorter prefixes: encode_stream() keeps these for a window of bytes. What is before a
    boundary that all prefixes within the lookahead share can no longer change and is emitted.
    Every piece goes through it; what it gave for a piece is kept in a cache of bounded size.

    The lookahead that suffices is the longest token: a later byte can only change the token that
    covers the present end, which begins at most that many bytes before it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {i: b for b, i in ranks.items()}
        self.lookahead = max(map(len, ranks), default=1)
        self.split = regex.compile(PATTERN)
        self._cache: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._selves: dict[int, bool] = {}
        self._ends: dict | None = None

    def merged(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, the leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) > CACHED:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merged(self.words[a] + self.words[b]) == [a, b]
        return got

    def _tokens_by_end(self) -> dict:
        """A trie of the reversed tokens; key None holds the id."""
        if self._ends is None:
            root: dict = {}
            for word, i in self.ranks.items():
                node = root
                for byte in reversed(word):
                    node = node.setdefault(byte, {})
                node[None] = i
            self._ends = root
        return self._ends

    def _whole(self, t: int) -> bool:
        """Whether a token encodes to itself."""
        got = self._selves.get(t)
        if got is None:
            got = self._selves[t] = self.merged(self.words[t]) == [t]
        return got

    def encode_stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one piece, byte by byte, each as soon as it is stable."""
        root, words = self._tokens_by_end(), self.words
        buf, last = bytearray(), [-1]  # last[i]: the last token of the encoding of buf[:i]
        for byte in data:
            buf.append(byte)
            n = len(buf)
            node, size, best = root, 0, []
            while size < n:
                node = node.get(buf[n - 1 - size])
                if node is None:
                    break
                size += 1
                if None in node:
                    best.append((size, node[None]))
            for size, t in reversed(best):
                if self._whole(t) and (size == n or self._fits(last[n - size], t)):
                    last.append(t)
                    break
            if n >= FLUSH and n % FLUSH == 0:
                stable = self._stable(last, n)
                if stable:
                    yield from self._read(last, stable)
                    del buf[:stable]
                    last = [-1, *last[stable + 1 :]]
        yield from self._read(last, len(buf))

    def _stable(self, last: list[int], n: int) -> int:
        """The last boundary that the encodings of all prefixes within the lookahead share."""
        chain, i = {n}, n
        while i:
            i -= len(self.words[last[i]])
            chain.add(i)
        least = n
        for j in range(max(1, n - self.lookahead + 1), n):
            i = j
            while i not in chain:
                i -= len(self.words[last[i]])
            least = min(least, i)
        return least

    def _read(self, last: list[int], i: int) -> list[int]:
        out = []
        while i:
            out.append(last[i])
            i -= len(self.words[last[i]])
        return out[::-1]

    def piece(self, piece: str) -> tuple[int, ...]:
        got = self._cache.get(piece)
        if got is None:
            got = tuple(self.encode_stream(piece.encode("utf-8", "replace")))
            if len(piece) <= KEPT:
                if len(self._cache) > CACHED:
                    self._cache.clear()
                self._cache[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Token ids without special tokens; none for an empty and for a null text."""
        out: list[int] = []
        if text:
            cached = self._cache.get
            for m in self.split.finditer(text):
                p = m.group()
                out += cached(p) or self.piece(p)
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete; a byte that belongs to no character gives U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield machine.decode(self.words[i])
        yield machine.decode(b"", True)


@cache
def load(vocabulary: bytes) -> ByteBpe:
    """From lines of a base64 token and its rank; one copy per Python worker."""
    return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())})
