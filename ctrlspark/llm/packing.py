"""Sum-of-squares packing of documents into token sequences.

Each document, tokenised and closed by an end id, is cut only if it is longer
than a sequence; whole-sequence pieces are sequences of their own.  The others
are dealt to shards at random (by a hash of their identity), so that all shards
see the same mix of lengths, and each shard packs them by the sum-of-squares
rule: a piece goes to the open bin, or to a new one, for which the sum over gap
sizes of (number of open bins with that gap) squared becomes smallest.  The rule
takes pieces in any order; here those over half a sequence come first, longest
first, then the middle ones at random, then the small ones, which close the
last gaps, again longest first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens, textvec
from .staging import staged
from .token_counts import library, rows_with

#: pieces in a shard, about: the bins that stay open at its end are few against those it fills
SHARD_PIECES = 40_000
#: pre-tokens remembered by a worker, about 100 bytes each; beyond that it starts afresh
MEMO = 700_000
#: masks of the first n of eight bytes
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Encoder:
    """Token ids of chunks: each distinct pre-token goes to the tokenizer once.

    One of up to sixteen bytes is remembered by its length and its first and last
    eight bytes, which are compared on each look-up; longer ones are not remembered.
    """

    def __init__(self, path: str):
        self.library = library(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bytes = np.zeros((0, 3), np.uint64)  # head, tail, size of each slot
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def starts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each byte: does a span begin here that is encoded independently of the others?"""
        return pretokens.starts(buf, offs)

    def ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids end to end, and each document's offset."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        start = np.flatnonzero(self.starts(buf, offs))
        end = np.append(start[1:], len(buf))
        example, group, key, known = distinct_spans(buf, start, end)
        if len(self.length) > MEMO:
            self.reset()
        slot = np.full(len(example), -1, np.int64)
        at = np.searchsorted(self.keys, key)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            there = self.keys[near] == key
            found = self.slot[near]
            fine = there & (self.bytes[found] == known).all(axis=1)
            slot[: len(key)][fine] = found[fine]
        else:
            there = np.zeros(len(key), bool)
        missing = np.flatnonzero(slot < 0)
        fresh = self._encoded(buf.tobytes(), start[example[missing]], end[example[missing]])
        slot[missing] = len(self.length) + np.arange(len(missing))
        length, flat = np.concatenate((self.length, fresh[0])), np.concatenate((self.flat, fresh[1]))
        first = np.concatenate((self.first, len(self.flat) + np.cumsum(fresh[0]) - fresh[0]))
        own = slot[group]
        ids = flat[textvec.ragged(first[own], length[own])]
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(length[own], out=total[1:])
        # the short ones stay, which come first
        short = missing[missing < len(key)]
        keep = np.flatnonzero(~there[short])
        self.length, self.first = length[: len(self.length) + len(short)], first[: len(self.first) + len(short)]
        self.flat = flat[: len(self.flat) + int(fresh[0][: len(short)].sum())]
        self.bytes = np.concatenate((self.bytes, known[short]))
        new = short[keep]
        self.keys, self.slot = np.insert(self.keys, at[new], key[new]), np.insert(self.slot, at[new], slot[new])
        return ids, total[np.searchsorted(start, offs)]

    def _encoded(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each span has, all ids)."""
        got = [e.ids for e in self.library.encode_batch([raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())], add_special_tokens=False)]
        return np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.uint32)


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(an example of each group, group of each span, key and known bytes of the first groups); spans of a group are equal.

    Up to sixteen bytes, the length and the first and last eight bytes are the span;
    groups of such come first, in order of their keys.  Longer ones are groups of their own.
    """
    n = end - start
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # eight bytes from each place
    head = eight[start] & _FIRST[np.minimum(n, 8)]
    tail = np.where(n > 8, eight[np.maximum(end - 8, 0)], np.uint64(0))
    key = textvec.mix(head ^ textvec.mix(tail + n.astype(np.uint64)))
    short = np.flatnonzero(n <= 16)
    names, example, inverse = np.unique(key[short], return_index=True, return_inverse=True)
    example = short[example]
    group = np.zeros(len(n), np.int64)
    group[short] = inverse
    same = example[inverse]
    alone = np.concatenate((np.flatnonzero(n > 16), short[(head[same] != head[short]) | (tail[same] != tail[short]) | (n[same] != n[short])]))
    group[alone] = len(example) + np.arange(len(alone))
    return np.concatenate((example, alone)), group, names, np.stack((head[example], tail[example], n[example].astype(np.uint64)), axis=1)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Tokenise and cut: doc_id, piece, start, length, ids_crc32; no piece is longer than ``size``.

    Of a longer document the first piece takes what the whole-length ones leave.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    closing = np.array([end_id], "<u4").tobytes()

    def cut(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        ids, at = enc.ids(buf, offs)
        ids = ids.astype("<u4")
        own = {int(d): np.array(enc.library.encode(buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids, "<u4") for d in rows_with(buf, offs, enc.special)}
        row, piece, start, length, crc = [], [], [], [], []
        for d in range(len(offs) - 1):
            doc = own[d] if d in own else ids[at[d] : at[d + 1]]
            n = len(doc) + 1
            a, b, k = 0, n % size or size, 0
            raw = doc.tobytes() + closing
            while a < n:
                row.append(d)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                a, b, k = b, b + size, k + 1
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return textvec.per_chunk(docs, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place of each length, in the order given; all lengths are below or at ``size``."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_at = np.zeros(size + 1, np.int64)  # open_at[g]: open bins with gap g; a closed bin (g = 0) counts nothing
    holding: list[list[int]] = [[] for _ in range(size + 1)]
    made = 0
    for i, n in enumerate(lengths.tolist()):
        # an open bin with gap g becomes one with gap g - n; half the change of the sum is open_at[g - n] - open_at[g] + 1
        cost = open_at[: size - n + 1] - open_at[n:] + 1
        cost = cost * 2
        cost[0] = -2 * open_at[n] + 1  # fills its bin: nothing is added at gap 0
        cost[open_at[n:] == 0] = 1 << 40  # no such bin
        fresh = 1 << 39 if n == 0 else (2 * open_at[size - n] + 1 if n < size else 0)
        g = int(cost.argmin())
        if cost[g] <= fresh:  # among equals the fullest bin
            gap = g + n
            b = holding[gap].pop()
            open_at[gap] -= 1
        else:
            gap, b, made = size, made, made + 1
        bins[i], places[i] = b, size - gap
        if gap > n:
            holding[gap - n].append(b)
            open_at[gap - n] += 1
    return bins, places


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, tokenizer: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack whole texts into sequences of at most ``size`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.  A null text is empty and takes one token, the end id; a
    null doc_id is packed like others; repeated rows are packed each; an empty
    table gives no rows; other columns are ignored.  The pieces table (no texts)
    is written once to the shared folder, as its row count sets the shards.
    """
    pieces = staged(token_pieces(docs, size, end_id, tokenizer), "pieces")
    whole = F.col("length") == size
    n = pieces.filter(~whole).count()
    shards = -(-n // shard_pieces) or 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = 1 << 40

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        length = pdf["length"].to_numpy()
        turn = np.where(length > size // 2, 0, np.where(length > size // 20, 1, 2))
        by = np.where(turn == 1, pdf["deal"].to_numpy(), -length)
        pdf = pdf.assign(turn=turn, by=by).sort_values(["turn", "by", "deal", "doc_id"], ignore_index=True)
        bins, places = sum_of_squares(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = bins + (pdf["shard"].to_numpy() + 1) * base if len(pdf) else bins
        pdf["offset"] = places
        return pdf.drop(columns=["shard", "deal", "turn", "by"])

    deal = F.xxhash64("doc_id", "piece", "ids_crc32")
    rest = pieces.filter(~whole).withColumns({"deal": F.shiftrightunsigned(deal, 2), "shard": F.pmod(deal, F.lit(shards))})
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = rest.groupBy("shard").applyInPandas(fill, out)
    alone = pieces.filter(whole).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)
