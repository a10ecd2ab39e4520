"""Tokens of many texts at once: runs of characters of a class, cut out of the texts as they lie in memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

from .text import WHITE_SPACE

POINTS = 0x110000


def spaces() -> np.ndarray:
    """Whether each code point is white space."""
    table = np.zeros(POINTS, bool)
    table[[ord(c) for c in WHITE_SPACE]] = True
    return table


def point_table(pattern: str) -> np.ndarray:
    """Whether each code point matches the character class ``pattern``."""
    table = np.zeros(POINTS, bool)
    for low, high in ((0, 0xD800), (0xE000, POINTS)):
        for run in regex.finditer(f"{pattern}+", "".join(map(chr, range(low, high)))):
            table[low + run.start() : low + run.end()] = True
    return table


def runs_of(texts: list[str], inside: np.ndarray, least: int) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, token) of every longest run of ``least`` or more characters for which ``inside`` holds.

    It does not hold for a line break, which keeps the texts apart.
    """
    joined = "\n".join(texts)
    data = joined.encode("utf-8")
    whole = np.frombuffer(data, np.uint8)
    points = whole if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    edges = np.flatnonzero(np.diff(inside[points], prepend=False, append=False)).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= least]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    number = np.searchsorted(ends, edges[:, 0], "right")
    if points is not whole:
        lead = np.append(np.flatnonzero((whole & 0xC0) != 0x80), len(whole))
        edges = lead[edges]
    if not len(edges):
        return number, pa.array([], pa.large_string())
    # Tokens and the gaps between them take turns in one array over the texts as they lie.
    both = pa.LargeStringArray.from_buffers(2 * len(edges) - 1, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(data))
    return number, both.take(pa.array(np.arange(0, 2 * len(edges), 2)))
