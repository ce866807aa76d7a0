"""Byte-level pre-tokenisation: the published split pattern as array operations.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``;
``starts`` marks where its matches begin.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, EDGE = 1, 2, 3, 4, 0
#: Unicode White_Space (fixed values)
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[_SPACES] = SPACE
    return table


def starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte of the chunk: does a pre-token begin here?"""
    n_bytes = len(buf)
    flags = np.zeros(n_bytes, bool)
    if not n_bytes:
        return flags
    ascii_only = not (buf >= 0x80).any()
    if ascii_only:
        cps, at, edges = buf, None, offs
    else:
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        edges = np.searchsorted(at, offs)
    n = len(cps)
    first = edges[:-1][edges[:-1] < edges[1:]]  # of documents that aren't empty
    last = edges[1:][edges[:-1] < edges[1:]] - 1
    cls = classes()[cps]
    prev = np.empty(n, np.uint8)
    prev[1:] = cls[:-1]
    prev[first] = EDGE
    blank = cps == 0x20
    after_blank = np.empty(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank[first] = False
    nonspace_next = np.empty(n, bool)
    nonspace_next[:-1] = cls[1:] != SPACE
    nonspace_next[last] = False
    space = cls == SPACE
    begin = np.where(space, (prev != SPACE) | nonspace_next, (prev != cls) & ~after_blank)
    quote = np.flatnonzero((cps == 0x27) & (prev != OTHER) & ~after_blank)
    if len(quote):
        end_of = last[np.searchsorted(last, quote)]
        pad = np.concatenate((cps.astype(np.uint32), np.zeros(3, np.uint32)))
        one, two = pad[quote + 1], pad[quote + 2]
        one = np.where(quote + 1 <= end_of, one, 0)
        two = np.where(quote + 2 <= end_of, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 2), (long & ~short, 3)):
            q = quote[hit]
            begin[q + 1] = False
            nxt = q + size
            nxt = nxt[nxt <= end_of[hit]]
            begin[nxt] = True
    if ascii_only:
        return begin
    flags[at] = begin
    return flags
