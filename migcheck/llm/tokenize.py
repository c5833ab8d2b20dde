"""Exact, cached use of the ``tokenizers`` library inside Spark tasks.

A text is cut into units whose ids do not depend on what stands around them, so the ids of a text are
the ids of its units in order, and repeated units are encoded once per worker.  Both supported kinds
of tokenizer (byte-level BPE, with or without word ends) always have a boundary before a run of white
space, and around a word of plain letters that only punctuation marks follow before the next white
space.  Such words go straight to the library's BPE model; all other units, and texts with white space
other than blank, tab and line ends, go to the whole tokenizer, which also finds its special tokens.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-/:-@\[-`{-~"
UNITS = re.compile(
    rf" ?[{LETTERS}]++(?=[{MARKS}]*+(?![^ \n\t\r]))"  # a word, perhaps behind a blank
    rf"|[{MARKS}]++(?![^ \n\t\r])"  # the marks behind it
    rf"|\n(?=[{LETTERS}])"
    r"|[ \n\t\r]*+[^ \n\t\r]++|[ \n\t\r]++"
)
WORD = re.compile(rf" ?[{LETTERS}]+")
OTHER_SPACE = re.compile(r"[^\S \n\t\r]")

#: Units remembered by one worker (about 200 bytes each); beyond them the memory starts anew.
UNITS_KEPT = 1_000_000

_encoders: dict[str, "PieceEncoder"] = {}


def byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable Latin-1 as is, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = byte_letters()
BLANK = BYTE_LETTERS[0x20]


PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids; as a dict it holds the ids of the units met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.fold = self.whole("Ab") == self.whole("ab") == self.whole(" ab")
        # the direct way to the model is taken only if it agrees with the whole tokenizer
        trial = ["word", " Word", "Über", " naïve", "état", " a", "Ñandú"]
        self.direct = [self.word(x) for x in trial] == [self.whole(x) for x in trial]

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """Ids of one word of letters, perhaps behind a blank, by way of the model."""
        if self.fold:
            word = word.lower().lstrip(" ")
        if word.isascii():
            written = BLANK + word[1:] if word[0] == " " else word
        else:
            written = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return packed([t.id for t in self.model.tokenize(written)])

    def __missing__(self, unit: str) -> bytes:
        ids = self[unit] = self.word(unit) if self.direct and WORD.fullmatch(unit) else self.whole(unit)
        return ids

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; a null text has none."""
        ids_of, cut, other = self.__getitem__, UNITS.findall, OTHER_SPACE.search
        for text in texts:
            if len(self) > UNITS_KEPT:
                self.clear()
            if not text:
                yield b""
            elif other(text):
                yield self.whole(text)
            else:
                yield b"".join(map(ids_of, cut(text)))

    def runs(self, texts: list[str | None], most_chars: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
        """(first text, ids of each) in runs of at most ``most_chars`` characters (or one text)."""
        first, size = 0, 0
        for at, text in enumerate(texts):
            if at > first and size + len(text or "") > most_chars:
                yield first, list(self.encode(texts[first:at]))
                first, size = at, 0
            size += len(text or "")
        if first < len(texts):
            yield first, list(self.encode(texts[first:]))
