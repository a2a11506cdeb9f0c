"""Token ids of whole texts by a public tokenizer file, with a memory of frequent words."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core already

END_ID = 1
PIECES_KEPT = 150_000
WORDS_KEPT = 300_000
LONGEST_KEPT = 48

#: A word of Latin letters, then marks that no rule of the vocabularies joins to a letter.
SIMPLE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?|&$#%()\[\]{}*=+/<>-]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the rest follow from code point 256 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = _byte_letters()


class Memory(dict):
    """Values by key, made when missing.  Two generations bound it: when the young one is
    full it becomes the old one, and what is still used moves over from there."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT and "\n" not in key:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class _Joined(Exception):
    """White space of a text runs over the place where it was cut."""


class Encoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``
    as little-endian unsigned 32-bit integers.

    Neither kind of vocabulary used here joins characters across a single blank or
    line end, so a text is cut there and the ids of pieces seen before are looked
    up.  A new piece that is one Latin word with closing marks is put together from
    the memory of words and of marks, where a new word goes to the merge model of
    the tokenizer; every other new piece goes through the whole tokenizer.  Where
    the vocabulary keeps white space and a run of it crosses a cut, the text is
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.drops_space = self.whole.normalizer is not None  # the vocabulary of words, in lower case
        self.vocabulary = self.whole.get_vocab_size()
        self.after_space = Memory(self._lower_piece if self.drops_space else self._spaced_piece, PIECES_KEPT)
        self.at_start = Memory(self._bare_piece, PIECES_KEPT // 4)
        self.words = Memory(self._word, WORDS_KEPT)
        self.line_end = self._all("\n")

    def _all(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():
            letters = word.replace(" ", LETTERS[32])
        else:
            letters = word.encode().decode("latin-1").translate(LETTERS)
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def _lower_piece(self, piece: str) -> bytes:
        found = SIMPLE.fullmatch(piece)
        if found:
            word, marks = found.groups()
            ids = self.words[word.lower()]
            return ids + self.words[marks] if marks else ids
        if "\n" in piece:
            return b"".join([self.after_space[part] for part in piece.split("\n")])
        return self._all(piece)

    def _spaced_piece(self, piece: str, before: str = " ") -> bytes:
        found = SIMPLE.fullmatch(piece)
        if found:
            word, marks = found.groups()
            ids = self.words[before + word]
            return ids + self.words[marks] if marks else ids
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Joined
        if "\n" in piece:
            first, *rest = piece.split("\n")
            start = self.after_space[first] if before else self.at_start[first]
            return self.line_end.join([start, *map(self.at_start.__getitem__, rest)])
        return self._all(before + piece)

    def _bare_piece(self, piece: str) -> bytes:
        return self._spaced_piece(piece, "")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.drops_space:
            return b"".join(map(self.after_space.__getitem__, text.split(" ")))
        try:
            first, *rest = text.split(" ")
            return self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest))
        except _Joined:
            return self._all(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
