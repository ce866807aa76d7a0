"""Vectorised text primitives used inside Arrow tasks.

Every function works on a *chunk*: the UTF-8 bytes of several whole documents
laid end to end (``buf``) with their byte offsets (``offs``, one more than there
are documents).  A chunk holds about ``CHUNK`` bytes, or one longer document.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CHUNK = 1 << 19
#: chunks after which a worker gives freed memory back: about 16 MB of text
TRIM_EVERY = 32

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: what a byte counts as in a hash: never 0, so that longer runs of one byte differ
_BYTE_KEYS = np.arange(1, 257, dtype=np.uint64)
#: A-Z hash like a-z
FOLDED_KEYS = _BYTE_KEYS[_FOLD]
#: hashes are polynomials over the integers modulo this prime, at a base drawn at random: two given
#: strings of n bytes have the same one with a chance of n / PRIME, whatever they are
PRIME = (1 << 61) - 1
_BASE = int(np.random.default_rng(20240229).integers(1 << 40, PRIME))
_U = np.uint64
#: odd multipliers for short sequences of finished hashes
_STEP = _U(0x9E3779B97F4A7C1B)
#: longer spans are summed in pieces, as their sums would not fit into 64 bits
LONGEST_PIECE = 1 << 23

#: word bytes: all but blanks (x20, x09-x0D)
NON_BLANK = np.ones(256, bool)
NON_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: word bytes: digits, letters and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def fold(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _FOLD[buf]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.where(x >= _U(PRIME), x - _U(PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for numbers below it."""
    low31, low30 = _U((1 << 31) - 1), _U((1 << 30) - 1)
    ah, al, bh, bl = a >> _U(31), a & low31, b >> _U(31), b & low31
    mid = ah * bl + al * bh
    return _reduced(_U(2) * ah * bh + (mid >> _U(30)) + ((mid & low30) << _U(31)) + al * bl)


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo PRIME."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = _times(out[:more], np.full(more, pow(base, size, PRIME), np.uint64))
        size += more
    return out


@lru_cache(1)
def _usual_tables() -> tuple[np.ndarray, ...]:
    return _tables(CHUNK + 1)


def _tables(n: int) -> tuple[np.ndarray, ...]:
    """Powers of the base (lower 32 bits, upper bits) and of its inverse."""
    power = _power_table(_BASE, n)
    return power & _U(0xFFFFFFFF), power >> _U(32), _power_table(pow(_BASE, -1, PRIME), n)


@lru_cache(1)
def keep_freed_memory() -> None:
    """Let the allocator of a worker reuse freed arrays, instead of mapping each anew (several times slower)."""
    with contextlib.suppress(OSError, AttributeError):  # only there with glibc
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 1 << 28), (-1, 1 << 27)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            libc.mallopt(option, value)


def release() -> None:
    """Give memory that a task has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def steps(n: int) -> np.ndarray:
    """n + 1 multipliers for the places of a short sequence."""
    out = np.full(n + 1, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all bits depend on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole documents; null texts are empty."""
    col = batch.column(batch.schema.names.index(column)).fill_null("").cast(pa.large_string())
    if not len(col):
        return
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, len(col))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def per_chunk(df: DataFrame, fn: Callable, schema: str | StructType, columns: tuple[str, ...] = ("doc_id", "text"), text: str = "text", size: int = CHUNK) -> DataFrame:
    """Map ``fn(rows, buf, offs)`` over chunks; ``rows`` is the matching slice of the batch.

    ``fn`` yields Arrow record batches of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        release()  # what earlier stages left: their broadcasts are dropped when a task of another one begins
        done = 0
        for batch in batches:
            for i, j, buf, offs in chunks(batch, text, size):
                yield from fn(batch.slice(i, j - i), buf, offs)
                done += 1
                if done % TRIM_EVERY == 0:
                    release()
        release()

    return df.select(*(f"`{c}`" for c in columns)).mapInArrow(run, schema)


class Prefix:
    """Sums from which the hash of any span of a chunk follows."""

    def __init__(self, buf: np.ndarray, keys: np.ndarray = _BYTE_KEYS):
        n = len(buf)
        low, high, self.inverse = _usual_tables() if n <= CHUNK else _tables(n + 1)
        value = keys[buf]
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        for power, out in ((low, self.low), (high, self.high)):  # signed sums are faster and the same bits
            np.cumsum((value * power[:n]).view(np.int64), out=out.view(np.int64)[1:])

    def _sum(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high = _reduced(self.high[ends] - self.high[starts])
        high = (high & _U((1 << 29) - 1)) << _U(32) | high >> _U(29)
        return _reduced(high + _reduced(self.low[ends] - self.low[starts]))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place-independent 64-bit hashes of the spans."""
        total = self._sum(starts, np.minimum(ends, starts + LONGEST_PIECE))
        more = np.flatnonzero(ends - starts > LONGEST_PIECE)
        while len(more):
            at = starts[more] + LONGEST_PIECE
            starts = np.copy(starts)
            starts[more] = at
            total[more] = _reduced(total[more] + self._sum(at, np.minimum(ends[more], at + LONGEST_PIECE)))
            more = more[ends[more] - at > LONGEST_PIECE]
        return total

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(_times(self.spans(starts, ends), self.inverse[starts]))


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes; none crosses a document's edge."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = is_word[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    inner = offs[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with A-Z folded, starts, ends, first word of each document and the end)."""
    starts, ends = word_spans(buf, offs, is_word)
    hashes = Prefix(buf, FOLDED_KEYS).hashes(starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def shingle_hashes(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles per document as (sorted hashes, offsets).

    A document of fewer words, but not none, has its whole word sequence as one shingle.
    """
    mult = steps(k)
    out, sizes = [], np.zeros(len(first), np.int64)
    n = len(word_hashes)
    if n >= k:
        grams = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            grams += word_hashes[i : n - k + 1 + i] * mult[i + 1]
        grams = mix(grams)
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            got = np.sort(grams[a : b - k + 1])
            got = got[np.concatenate(([True], got[1:] != got[:-1]))]
        elif b > a:
            got = mix((word_hashes[a:b] * mult[1 : b - a + 1]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            continue
        out.append(got)
        sizes[d + 1] = len(got)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(sizes)


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int, key: Callable[[pa.Table], np.ndarray] = lambda t: t["key"].to_numpy()) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that cut no key, of batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            keys = key(table)
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)
