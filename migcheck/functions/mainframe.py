"""Mainframe encodings as column expressions: EBCDIC text, packed decimals, PIC clauses."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_PAGES = ("cp037", "ebcdic")


def decode_ebcdic(raw: Column, code_page: str = "cp037") -> Column:
    """Text of bytes in code page 037; NUL bytes become blanks."""
    if code_page.lower() not in CODE_PAGES:
        raise ValueError(f"code page {code_page} is not supported")
    codes = bytes(range(1, 256))
    pairs = F.regexp_replace(F.regexp_replace(F.hex(raw), "(..)", "$1,"), "00,", "40,")
    plain = F.decode(F.unhex(F.replace(pairs, F.lit(","), F.lit(""))), "ISO-8859-1")
    return F.translate(plain, codes.decode("latin-1"), codes.decode("cp037"))


def decode_packed(raw: Column, decimals: int = 0) -> Column:
    """Decimal text of a packed number: two digits a byte, the sign in the last half byte (D: negative)."""
    text = F.hex(raw)
    digits = F.substring(text, F.lit(1), F.length(text) - 1)
    whole = F.regexp_replace(digits, "^0+(?=.)", "")
    if decimals:
        padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(decimals + 1)), "0")
        at = F.length(padded) - decimals
        whole = F.concat(
            F.regexp_replace(F.substring(padded, F.lit(1), at), "^0+(?=.)", ""), F.lit("."), F.substring(padded, at + 1, F.lit(decimals))
        )
    return F.when(F.length(text) == 0, "0").otherwise(F.concat(F.when(F.right(text, F.lit(1)) == "D", "-").otherwise(""), whole))


# Digits up to which a binary field takes so many bytes, and a whole number fits a SQL type.
BINARY_BYTES = {4: 2, 9: 4, 18: 8}
WHOLE_TYPES = {4: "SMALLINT", 9: "INTEGER", 18: "BIGINT"}


@dataclass(frozen=True)
class Picture:
    """A PIC clause by its symbols: characters (X, A), digits before and behind the point (9 around V or .)."""

    characters: int
    whole: int
    scale: int
    pointed: bool

    @classmethod
    def of(cls, clause: str) -> Picture:
        counts = {"text": 0, "whole": 0, "scale": 0}
        pointed = False
        for symbol, times in re.findall(r"([A-Z9.])(?:\((\d+)\))?", clause.upper()):
            if symbol in "V.":
                pointed = True
            elif symbol in "AX":
                counts["text"] += int(times or 1)
            elif symbol == "9":
                counts["scale" if pointed else "whole"] += int(times or 1)
        return cls(counts["text"], counts["whole"], counts["scale"], pointed)

    @property
    def digits(self) -> int:
        return self.whole + self.scale


def fitting(digits: int, steps: dict[int, int | str]) -> int | str | None:
    """The entry of the smallest step that holds so many digits."""
    return next((steps[most] for most in sorted(steps) if digits <= most), None)


def pic_bytes(pic: str, usage: str = "") -> int:
    picture = Picture.of(pic)
    if usage in ("COMP-3", "PACKED-DECIMAL"):
        return picture.digits // 2 + 1  # a half byte for each digit and one for the sign
    if usage in ("COMP", "BINARY"):
        return fitting(picture.digits, BINARY_BYTES) or 8
    return picture.characters + picture.digits


def pic_type(pic: str) -> str:
    """The SQL type of a PIC clause: text if it has characters, else a number of its digits."""
    picture = Picture.of(pic)
    if picture.characters:
        size = pic_bytes(pic)
        return f"VARCHAR({size})" if size > 1 else "CHAR(1)"
    if picture.pointed:
        return f"NUMERIC({picture.digits},{picture.scale})"
    return fitting(picture.digits, WHOLE_TYPES) or f"NUMERIC({picture.digits})"
