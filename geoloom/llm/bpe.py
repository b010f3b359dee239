"""Cached byte-level BPE: texts are cut at boundaries that the tokenizer's own splitting must also have, and what
lies between them is encoded once by the tokenizers library and then looked up.

Every shortcut is exact. A text that holds a special token's string, or a character whose class could differ
between Unicode versions, goes to the library as it is.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from functools import lru_cache

from .common import Memo

#: Code points with the White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Not a space since Unicode 6.3.
CHANGED = "᠎"
#: Letters below have had their class since Unicode 3.2.
STABLE_LETTERS = "\u0200"
#: What often follows a word; kept out of the cache together with it.
MARKS = frozenset(".,;:!?")


class Unsafe(Exception):
    """A text can't be cut at its spaces."""


def _ranges(member) -> str:
    found, start = [], None
    for i in range(0x10001):
        if i < 0x10000 and member(chr(i)):
            start = i if start is None else start
        elif start is not None:
            found.append(f"\\u{start:04x}-\\u{i - 1:04x}")
            start = None
    return "".join(found)


@lru_cache(1)
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """The GPT-2 splitting pattern with its classes spelled out, and a full match of characters of stable class."""
    kind = lambda c: k if (k := unicodedata.category(c)[0]) in "LN" else ""
    old = unicodedata.ucd_3_2_0
    old_kind = lambda c: k if (k := old.category(c)[0]) in "LN" else ""
    letters, numbers = _ranges(lambda c: kind(c) == "L"), _ranges(lambda c: kind(c) == "N")
    white = "".join(f"\\u{ord(c):04x}" for c in WHITE)
    split = re.compile(
        f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+"
        f"|[{white}]+(?![^{white}])|[{white}]+"
    )
    stable = _ranges(lambda c: old.category(c) not in ("Cn", "Cs") and kind(c) == old_kind(c) and c not in CHANGED)
    return split, re.compile(f"[{stable}]*")


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Chunks(Memo):
    """Chunks; a word with a mark behind it is put together from both each time, so words are held once."""

    def __init__(self, make, most: int, encoder):
        super().__init__(make, most)
        self.encoder = encoder

    def __missing__(self, key):
        if key[-1:] in MARKS and (word := key[:-1]).isalpha() and max(word) < STABLE_LETTERS:
            return self.encoder.join((self.encoder.front[word], self.encoder.piece[key[-1]]))
        return super().__missing__(key)


class Front(dict):
    """Values of frequent words, asked before a worker's cache."""

    def __init__(self, values: dict, cache: Memo):
        super().__init__(values)
        self.cache = cache

    def __missing__(self, key):
        return self.cache[key]


class CachedBpe:
    """Encodes texts to what `reduce` makes of their ids; `known(piece)` may answer before the library does.

    lift: ids of a pre-token -> value; join: values -> value (sum for counts, b"".join for bytes).
    """

    def __init__(self, path: str, lift, join, known=None, pieces: int = 250_000, chunks: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lift, self.join, self.known = lift, join, known
        self.split, self.stable = patterns()
        self.piece = Memo(self._piece, pieces)
        self.chunk = _Chunks(self._chunk, chunks, self)
        #: Where chunks are looked up first; what it lacks goes to the cache.
        self.front = self.chunk

    def _piece(self, piece: str):
        if self.known and (found := self.known(piece)) is not None:
            return found
        letters = piece.encode().decode("latin-1").translate(byte_letters())
        return self.lift([t.id for t in self.model.tokenize(letters)])

    def _plain(self, text: str) -> bool:
        return not any(s in text for s in self.specials) and self.stable.fullmatch(text) is not None

    def _chunk(self, chunk: str):
        """What a space and the chunk up to the next space come to."""
        if chunk.isalpha() and max(chunk) < STABLE_LETTERS:
            return self._piece(" " + chunk)
        if not chunk or chunk[0] in WHITE or chunk[-1] in WHITE or not self._plain(chunk):
            raise Unsafe
        return self.join(map(self.piece.__getitem__, self.split.findall(" " + chunk)))

    def _whole(self, text: str):
        if self._plain(text):
            return self.join(map(self.piece.__getitem__, self.split.findall(text)))
        return self.lift(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str | None):
        if not text:
            return self.join(())
        head, *rest = text.split(" ")
        try:
            if head and (head[-1] in WHITE or not self._plain(head)):
                raise Unsafe
            first = [self.join(map(self.piece.__getitem__, self.split.findall(head)))]
            first += map(self.front.__getitem__, rest)
            return self.join(first)
        except Unsafe:
            return self._whole(text)


@lru_cache(2)
def counter(path: str) -> CachedBpe:
    """A worker's counter of tokens; it lives as long as the worker."""
    return CachedBpe(path, len, sum)


@lru_cache(2)
def serializer(path: str, width: int) -> CachedBpe:
    """A worker's encoder to little-endian id arrays of `width` bytes an id."""
    kind = {2: "H", 4: "I"}[width]

    def lift(ids: list[int]) -> bytes:
        row = array(kind, ids)
        if sys.byteorder == "big":
            row.byteswap()
        return row.tobytes()

    return CachedBpe(path, lift, b"".join)
