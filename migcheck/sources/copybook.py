"""Record layouts from COBOL copybooks: a small reader of level, name, PIC, USAGE, OCCURS and REDEFINES."""

from __future__ import annotations

import re
from dataclasses import dataclass

from migcheck.functions.mainframe import Picture, pic_bytes, pic_type

ENTRY = re.compile(r"^(\d{1,2})\s+([\w-]+)\s*(.*)$", re.S)
CLAUSES = {
    "pic": re.compile(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", re.I),
    "usage": re.compile(r"\b(COMP-3|PACKED-DECIMAL|COMP|BINARY|DISPLAY)\b", re.I),
    "occurs": re.compile(r"\bOCCURS\s+(\d+)", re.I),
    "redefines": re.compile(r"\bREDEFINES\s+([\w-]+)", re.I),
}


@dataclass(frozen=True)
class Field:
    name: str
    pic: str
    usage: str
    offset: int
    length: int
    decimals: int
    sql_type: str

    @property
    def column(self) -> str:
        return self.name.lower().replace("-", "_")

    @property
    def is_filler(self) -> bool:
        return self.name.startswith("FILLER")


def entries(text: str) -> list[str]:
    """Statements up to their full stop, without comment lines, sequence numbers and identification columns."""
    lines = []
    for line in text.splitlines():
        numbered = len(line) > 6 and (line[:6].isdigit() or not line[:6].strip())
        body = line[6:72] if numbered else line
        if body[:1] != "*" and not line.lstrip().startswith("*"):
            lines.append(body)
    return [" ".join(s.split()) for s in re.split(r"\.(?=\s|$)", "\n".join(lines)) if s.strip()]


def parse(text: str) -> list[Field]:
    """The elementary fields with byte offsets; a redefining field lies over another and moves nothing."""
    fields, offset = [], 0
    starts: dict[str, int] = {}
    for statement in entries(text):
        entry = ENTRY.match(statement)
        if not entry or entry[1] == "88":
            continue
        found = {k: (m[1].upper() if (m := p.search(entry[3])) else "") for k, p in CLAUSES.items()}
        start = starts[entry[2].upper()] = starts.get(found["redefines"], offset)
        if not found["pic"]:
            continue
        length = pic_bytes(found["pic"], found["usage"]) * int(found["occurs"] or 1)
        fields.append(Field(entry[2].upper(), found["pic"], found["usage"], start, length, Picture.of(found["pic"]).scale, pic_type(found["pic"])))
        offset += 0 if found["redefines"] else length
    return fields


def record_length(fields: list[Field]) -> int:
    return max((f.offset + f.length for f in fields), default=0)
