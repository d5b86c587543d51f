"""Runs of letters and digits in lower case, as spans of code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from fleetlens.llm.text import Prefixes, code_points, once, text_buffer

LOWER, UPPER, DIGIT, BLANK, MARK = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point."""
    kind = np.full(0x110000, MARK, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] == "L" or category[0] == "M":
            kind[c] = UPPER if category in ("Lu", "Lt") else LOWER
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif category[0] == "N":
            kind[c] = DIGIT
        elif chr(c).isspace():
            kind[c] = BLANK
    return kind, lower


class Words:
    """Runs of letters and digits of some texts, in lower case."""

    def __init__(self, texts: pa.Array) -> None:
        kinds, lower = once("letter tables", _tables)
        data, offsets = text_buffer(texts)
        self.points, _, self.bounds = code_points(data, offsets)
        self.kind = kinds[self.points] if len(self.points) else np.zeros(0, np.uint8)
        n = len(self.points)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = (self.kind == LOWER) | (self.kind == UPPER) | (self.kind == DIGIT)
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))
        self.lower = lower[self.points] if n else self.points
        self.hashed = Prefixes(self.lower)

    def whole(self) -> np.ndarray:
        """Hashes of the words."""
        return self.hashed.run(self.starts, self.ends)

    def stems(self, lengths: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words and the hashes of their first letters, for each length; last, whole words."""
        size = self.ends - self.starts
        for k in lengths:
            which = np.flatnonzero(size >= k)
            yield which, self.hashed.run(self.starts[which], self.starts[which] + k)
        yield np.arange(len(size)), self.whole() ^ np.uint64(1)
