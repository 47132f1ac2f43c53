"""What extractors give: symbols and raw edges of one file."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

#: The symbol that stands for a whole file.
FILE = "<file>"


@dataclass(slots=True)
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    start_byte: int
    end_byte: int
    signature: str | None = None


@dataclass(slots=True)
class Edge:
    src_name: str
    dst_name: str
    kind: str
    confidence: str


@dataclass
class Extraction:
    """status: graph (symbols and edges), outline (symbols), file (neither) or error."""

    status: str
    symbols: list[Symbol] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)


STEP = 1024
_BREAK = re.compile("\n")


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


class Places:
    """Lines and UTF-8 bytes of character offsets."""

    def __init__(self, source: str):
        self.source = source
        self.starts = array("q", [0])
        self.starts.extend(m.end() for m in _BREAK.finditer(source))
        # bytes before every STEP-th character; of other characters only those behind it are encoded
        self.bytes_at = None if source.isascii() else array("q", accumulate((len(_utf8(source[k : k + STEP])) for k in range(0, len(source), STEP)), initial=0))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def byte(self, at: int) -> int:
        return at if self.bytes_at is None else self.bytes_at[at // STEP] + len(_utf8(self.source[at - at % STEP : at]))

    def symbol(self, name: str, kind: str, start: int, end: int, signature: str | None = None) -> Symbol:
        """A symbol over characters [start, end)."""
        first = self.line(start)
        return Symbol(name, kind, first, max(first, self.line(max(start, end - 1))), self.byte(start), self.byte(end), signature)

    def module(self) -> Symbol:
        return self.symbol(FILE, "module", 0, len(self.source))
