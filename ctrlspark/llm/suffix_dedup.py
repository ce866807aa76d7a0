"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

Every window of ``width`` bytes picks one anchor, the smallest hash of its
``GRAM``-byte substrings, so equal windows pick equal anchors at equal places, and
the windows of one anchor stand in a row (a run).  Anchors that occur once in the
corpus are counted away.  What is indexed are the suffixes that begin at the other
anchors, with the bytes before them that their windows cover; entries of one anchor
go to one task.

Documents come in batches of rising doc_id.  A batch's suffixes and those of the
levels that exist (all of earlier documents) are put in suffix order, and their
prefixes (read backwards from the anchor) likewise; the common lengths of neighbours
in both orders tell which windows are equal, byte for byte.  What the batch brings
that is new becomes a level of its own; levels of equal size merge, so n batches
make at most log2(n) + 1 levels.

Hot anchors, which a passage in a great part of all documents makes, are split: their
windows are dealt by the distance to the anchor, a few at a time, with a hash of the
bytes that these have in common as key.  Entries with equal bytes in a chunk count as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .staging import discard, staged

GRAM = 32
#: longer documents are taken in overlapping pieces of so many bytes
PIECE = 1 << 20
PLACE = np.uint64(2**28 - 1)
#: repeated anchors and copied texts that are broadcast; beyond that they are joined by shuffle
BROADCAST_ANCHORS, BROADCAST_TEXTS = 6_000_000, 200_000
#: an anchor of more runs than this, and than HOT_SHARE of all (which bounds their number), is hot; window distances that stay together then
HOT_RUNS, HOT_SHARE, HOT_STEP = 4096, 1e-6, 4
#: entries compared at a time in a task
BLOCK_ROWS = 60_000
LAST = 2**63 - 1
#: odd multipliers of the eight-byte words of a substring; bytes are compared later, so this hash need not be strong
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Runs:
    """Runs of windows with one anchor: anchor (hash), at (its place), first window, number of windows, document."""

    # (an anchor is one place of a substring; a substring that comes again is another)

    def __init__(self, buf: np.ndarray, offs: np.ndarray, width: int):
        n = len(buf)
        none = np.zeros(0, np.int64)
        self.anchor, self.at, self.first, self.count, self.doc = none.astype(np.uint64), none, none, none, none
        if n < width:
            return
        eight = np.ndarray(n - 7, "<u8", np.ascontiguousarray(buf), strides=(1,))
        last = n - GRAM + 1
        gram = textvec.mix(sum(eight[8 * k : 8 * k + last] * _MIX[k] for k in range(GRAM // 8)))
        # the upper bits choose, the place (below 2**28) makes the leftmost of equal ones smallest
        low = gram & ~PLACE | np.arange(last).astype(np.uint64)
        reach, span = 1, width - GRAM + 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: reach - span], low[span - reach :])
        fits = np.ones(n + 1, bool)
        tail = np.minimum(np.diff(offs), width - 1)
        fits[textvec.ragged(offs[1:] - tail, tail)] = False
        fits = fits[: n - width + 1]
        begins = fits.copy()
        begins[1:] &= ~fits[:-1] | (low[1:] != low[:-1])
        starts = offs[:-1][offs[:-1] < len(begins)]
        begins[starts] |= fits[starts]
        self.first = np.flatnonzero(begins)
        self.at = (low[self.first] & PLACE).astype(np.int64)
        self.anchor = gram[self.at]
        # a run ends where the next one begins or where windows stop fitting
        self.count = np.bincount(np.cumsum(begins)[np.flatnonzero(fits)] - 1, minlength=len(self.first))
        self.doc = np.searchsorted(offs, self.first, "right") - 1

    def taken(self, which: np.ndarray) -> None:
        self.anchor, self.at, self.first, self.count, self.doc = (x[which] for x in (self.anchor, self.at, self.first, self.count, self.doc))

    def split(self, hot: np.ndarray, prefix: textvec.Prefix, width: int) -> None:
        """Cut the runs that are ``hot`` at distances divisible by HOT_STEP, and give each part a key of its own."""
        far = self.at - self.first  # distances go from far down to near
        near = far - self.count + 1
        parts = np.where(hot, far // HOT_STEP - near // HOT_STEP + 1, 1)
        of = np.repeat(np.arange(len(parts)), parts)
        step = far[of] // HOT_STEP - (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        top = np.where(hot[of], np.minimum(far[of], step * HOT_STEP + HOT_STEP - 1), far[of])
        bottom = np.where(hot[of], np.maximum(near[of], step * HOT_STEP), near[of])
        self.taken(of)
        self.first, self.count = self.at - top, top - bottom + 1
        on = np.flatnonzero(hot[of])
        # all windows of a part hold these bytes, at these distances
        common = prefix.hashes(self.at[on] - step[on] * HOT_STEP, self.at[on] + width - np.minimum(step[on] * HOT_STEP + HOT_STEP - 1, width - GRAM))
        self.anchor[on] = textvec.mix(self.anchor[on] ^ textvec.mix(common + step[on].astype(np.uint64)))


def _pieces(buf: np.ndarray, offs: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets) of parts of a chunk that hold each window once."""
    if len(buf) <= 2 * PIECE:
        yield 0, buf, offs
        return
    for d in range(len(offs) - 1):  # one long document, as chunks are made
        for a in range(int(offs[d]), int(offs[d + 1]), PIECE):
            b = min(a + PIECE + width - 1, int(offs[d + 1]))
            yield a, buf[a:b], np.concatenate((np.zeros(d + 1, np.int64), np.full(len(offs) - 1 - d, b - a)))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (long, null ones last), text_key, copy_key and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("text_key"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("copy_key"), "text")


def copied_texts(docs: DataFrame, width: int) -> DataFrame:
    """copy_key and first doc of texts of ``width`` bytes or more that several documents have."""
    long = _keyed(docs).filter(F.octet_length("text") >= width)
    return long.groupBy("copy_key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("copy_key", "first")


def _without_copies(docs: DataFrame, copies: DataFrame, few: bool) -> DataFrame:
    known = copies.select(F.col("copy_key").alias("__key"), "first")
    joined = docs.join(F.broadcast(known) if few else known, F.col("copy_key") == F.col("__key"), "left")
    return joined.filter("first is null or doc <= first").select("doc", "text_key", "text")


def anchor_counts(docs: DataFrame, width: int) -> DataFrame:
    """anchor, n (runs) of all anchors."""

    def count(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for _, part, ends in _pieces(buf, offs, width):
            anchor, n = np.unique(Runs(part, ends, width).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return textvec.per_chunk(docs, count, "anchor long, n long", ("text",)).groupBy("anchor").agg(F.sum("n").alias("n"))


def _among(names: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted names."""
    return names[np.minimum(np.searchsorted(names, values), len(names) - 1)] == values if len(names) else np.zeros(len(values), bool)


ENTRY = "key long, doc long, text_key long, first long, n int, at int, bytes binary"


def _entries(docs: DataFrame, width: int, picked: Broadcast | None, hot: Broadcast) -> DataFrame:
    """Runs as entries: key, anchor, doc, text_key, first window, n windows, at (anchor after the first window), bytes.

    Runs whose bytes an earlier entry of the chunk has are no entries, but repeated
    stretches at once (``bytes`` null).
    """

    def build(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, texts = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        for base, part, ends in _pieces(buf, offs, width):
            runs = Runs(part, ends, width)
            if picked is not None:
                runs.taken(np.flatnonzero(_among(picked.value, runs.anchor.view(np.int64))))
            if not len(runs.first):
                continue
            anchor = runs.anchor.view(np.int64)
            is_hot = _among(hot.value, anchor)
            prefix = textvec.Prefix(part)
            if is_hot.any():
                number = np.arange(len(anchor))
                parts = Runs.__new__(Runs)
                parts.anchor, parts.at, parts.first, parts.count, parts.doc = runs.anchor, runs.at, runs.first, runs.count, number
                parts.split(is_hot, prefix, width)
                anchor, doc = anchor[parts.doc], runs.doc[parts.doc]
                runs = parts
            else:
                doc = runs.doc
            first, size = runs.first, runs.count + width - 1
            key, at = runs.anchor.view(np.int64), runs.at - first
            place = first + base - np.where(base, 0, offs[doc])
            same = textvec.mix(prefix.hashes(first, first + size) ^ textvec.mix(runs.anchor + (at * 4096 + runs.count).astype(np.uint64)))
            by = np.lexsort((place, texts[doc], ids[doc], same))
            lead = np.ones(len(by), bool)
            lead[1:] = same[by][1:] != same[by][:-1]
            leader = np.empty(len(by), np.int64)
            leader[by] = by[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            again = np.flatnonzero(leader != np.arange(len(by)))
            raw = part.tobytes()
            equal = np.array([raw[first[i] : first[i] + size[i]] == raw[first[j] : first[j] + size[j]] and at[i] == at[j] for i, j in zip(again, leader[again])], bool)
            again = again[equal]
            own = np.ones(len(by), bool)
            own[again] = False
            j = leader[again]
            # equal places (repeated rows) are no earlier than each other
            again = again[(ids[doc[again]] != ids[doc[j]]) | (texts[doc[again]] != texts[doc[j]]) | (place[again] != place[j])]
            own = np.flatnonzero(own)
            edges = np.concatenate(([0], np.cumsum(size[own]))).astype(np.int32)
            flat = part[textvec.ragged(first[own], size[own])]
            held = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(flat.tobytes())])
            for which, data in ((own, held), (again, pa.nulls(len(again), pa.binary()))):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[which]), pa.array(key[which]), pa.array(ids[doc[which]]), pa.array(texts[doc[which]]), pa.array(place[which]), pa.array(runs.count[which].astype(np.int32)), pa.array(at[which].astype(np.int32)), data], ["anchor", "key", "doc", "text_key", "first", "n", "at", "bytes"])

    return textvec.per_chunk(docs, build, f"anchor long, {ENTRY}", ("doc", "text_key", "text"))


def _common(rows: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each row and the one before it (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _sorted_bytes(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by key and then by bytes, equal leading bytes of neighbours of one key)."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    order = order[np.argsort(key[order], kind="stable")]
    common = _common(rows[order])
    common[1:][key[order][1:] != key[order][:-1]] = -1
    common[0] = -1
    return order, common


def equal_windows(table: dict[str, np.ndarray], flat: np.ndarray, edges: np.ndarray, width: int) -> np.ndarray:
    """Row by distance from the window to the anchor: does an earlier window hold the same bytes?

    ``table``: key, rank (place in the order of what is earlier), at and n of each
    entry; ``flat`` and ``edges``: their bytes.
    """
    reach = width - GRAM
    key, rank, at, n = (table[c] for c in ("key", "rank", "at", "n"))
    size = np.diff(edges)
    m = len(key)
    after, before = np.zeros((m, width), np.uint8), np.zeros((m, reach), np.uint8)
    room = np.minimum(size - at, width)
    row = np.repeat(np.arange(m), room)
    after[row, textvec.ragged(np.zeros(m, np.int64), room)] = flat[textvec.ragged(edges[:-1] + at, room)]
    row = np.repeat(np.arange(m), at)
    step = textvec.ragged(np.zeros(m, np.int64), at)
    before[row, step] = flat[np.repeat(edges[:-1] + at - 1, at) - step]
    (right, more), (left, less) = _sorted_bytes(key, after), _sorted_bytes(key, before)
    right_at, left_at = np.empty(m, np.int64), np.empty(m, np.int64)
    right_at[right], left_at[left] = np.arange(m), np.arange(m)
    # no window beyond what a row has in common with a neighbour can be equal to another
    most = lambda c: np.maximum(c, np.append(c[1:], -1))
    low = np.maximum(at - n + 1, width - most(more)[right_at])
    high = np.minimum(at, most(less)[left_at])
    out = np.zeros((m, reach + 1), bool)
    by_age = np.argsort(rank, kind="stable")
    for d in range(reach + 1):
        rows = by_age[(low[by_age] <= d) & (high[by_age] >= d)]
        if len(rows) > 1:
            same = np.cumsum(more < width - d)[right_at[rows]] * (m + 1) + np.cumsum(less < d)[left_at[rows]]
            _, oldest, group = np.unique(same, return_index=True, return_inverse=True)
            out[rows, d] = rank[rows] > rank[rows[oldest[group]]]
    return out


def _merge_scan(batch: DataFrame, levels: list[DataFrame], width: int) -> DataFrame:
    """Scan a batch's suffixes against the levels and themselves.

    Rows without bytes are repeated stretches (doc, text_key, first, n windows); the
    others are the entries of the batch's new level, in suffix order of each task.
    """
    both = batch.withColumn("old", F.lit(False))
    for level in levels:
        both = both.unionByName(level.withColumn("old", F.lit(True)))

    def look(got: pa.Table) -> Iterator[pa.RecordBatch]:
        got = got.combine_chunks()
        part = {c: got[c].to_numpy() for c in ("key", "doc", "text_key", "first", "n", "at", "old")}
        part["at"], part["n"] = part["at"].astype(np.int64), part["n"].astype(np.int64)
        held = got["bytes"].chunk(0)
        edges = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        flat = np.frombuffer(held.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        order = np.lexsort((part["first"] + part["at"], part["text_key"], part["doc"], ~part["old"]))
        fresh = np.ones(len(order), bool)
        columns = [part["old"], part["doc"], part["text_key"], part["first"] + part["at"]]
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        fresh |= part["old"][order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh)  # equal places (repeated rows) are no earlier than each other
        repeated = equal_windows({**part, "rank": rank}, flat, edges, width)
        new = np.flatnonzero(~part["old"])
        # windows of a row in order of places: from the greatest distance to the least
        marks = np.zeros((len(new), repeated.shape[1] + 2), np.int8)
        marks[:, 1:-1] = repeated[new][:, ::-1]
        step = np.diff(marks, axis=1)
        row, a = np.nonzero(step == 1)
        _, b = np.nonzero(step == -1)
        place = part["first"][new][row] + part["at"][new][row] - (repeated.shape[1] - 1 - a)
        empty = np.zeros(len(row), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part["key"][new][row]), pa.array(part["doc"][new][row]), pa.array(part["text_key"][new][row]), pa.array(place), pa.array((b - a).astype(np.int32)), pa.array(empty), pa.nulls(len(row), pa.binary())], ["key", "doc", "text_key", "first", "n", "at", "bytes"])
        # windows that an earlier entry has need no second one
        keep = new[repeated[new].sum(axis=1) < part["n"][new]]
        keep = pa.array(keep[np.argsort(part["key"][keep], kind="stable")])
        yield pa.RecordBatch.from_arrays([got[c].chunk(0).take(keep) for c in ("key", "doc", "text_key", "first", "n", "at", "bytes")], ["key", "doc", "text_key", "first", "n", "at", "bytes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textvec.keep_freed_memory()
        for table in textvec.whole_keys(batches, BLOCK_ROWS):
            yield from look(table)
        textvec.release()

    return both.repartition("key").sortWithinPartitions("key").mapInArrow(scan, ENTRY)


def repeated_stretches(docs: DataFrame, width: int = 100, batches: int = 4) -> tuple[DataFrame, DataFrame, bool]:
    """(doc, text_key, stretches of repeated windows), (copied texts), are those few."""
    spark = docs.sparkSession
    copies = staged(copied_texts(docs, width), "copies")
    few = copies.count() <= BROADCAST_TEXTS
    own = _without_copies(_keyed(docs), copies, few)
    anchors = staged(anchor_counts(own, width).filter("n > 1"), "anchors")
    sizes = anchors.agg(F.count("*").alias("rows"), F.sum("n").alias("runs")).first()
    picked = None
    if sizes["rows"] <= BROADCAST_ANCHORS:
        picked = spark.sparkContext.broadcast(np.sort(anchors.select("anchor").toArrow()["anchor"].to_numpy()))
    hot = anchors.filter(F.col("n") > max(HOT_RUNS, (sizes["runs"] or 0) * HOT_SHARE)).select("anchor").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(hot["anchor"].to_numpy()))
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc")).approxQuantile("doc", [i / batches for i in range(1, batches)], 0.001) if batches > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    levels: list[tuple[int, DataFrame]] = []
    found = []
    for low, high in zip(edges, edges[1:]):
        part = own.filter((F.col("doc") > low) if low is not None else F.lit(True)).filter((F.col("doc") <= high) if high is not None else F.lit(True))
        entries = _entries(part, width, picked, hot)
        if picked is None:
            entries = entries.join(anchors.select("anchor"), "anchor", "left_semi")
        entries = staged(entries.drop("anchor"), "entries")
        scanned = staged(_merge_scan(entries.filter("bytes is not null"), [t for _, t in levels], width), "scan")
        found += [staged(t.filter("bytes is null").select("doc", "text_key", "first", "n"), "stretches") for t in (entries, scanned)]
        discard(entries)
        if high is None:
            discard(scanned)
            break
        levels.append((1, scanned.filter("bytes is not null")))
        while len(levels) > 1 and levels[-1][0] == levels[-2][0]:
            (size, b), (_, a) = levels.pop(), levels.pop()
            levels.append((2 * size, staged(a.unionByName(b).repartition("key").sortWithinPartitions("key"), "level")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    packed = rows.groupBy("doc", "text_key").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("stretches"))
    return packed, copies, few


def _cut_spans(stretches: list, width: int) -> list[list[int]]:
    """Maximal removed byte spans from stretches of windows (sorted by first)."""
    out: list[list[int]] = []
    for s in stretches or ():
        a, b = s["first"], s["first"] + s["n"] - 1 + width
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def removed_spans(docs: DataFrame, width: int = 100, batches: int = 4) -> DataFrame:
    """``docs`` with ``spans``: maximal runs of bytes covered by a ``width``-byte string that also starts earlier.

    Returns one row per document: doc_id, text, spans (start, end in UTF-8 bytes).
    Earlier means in a smaller doc_id, or in the same at an earlier start; matches
    don't cross documents.  doc_id is an integer; null ones come after all others.
    Null texts are empty.  Repeated rows (equal doc_id and text) are not earlier
    than each other.  An empty table gives none; other columns are ignored.
    """
    packed, copies, few = repeated_stretches(docs, width, batches)
    packed = packed.toDF("__doc", "__key", "stretches")
    known = copies.toDF("__copy", "first")
    keyed = _keyed(docs).withColumn("doc_id", F.when(F.col("doc") < LAST, F.col("doc")))
    out = keyed.join(F.broadcast(known) if few else known, F.col("copy_key") == F.col("__copy"), "left")
    out = out.join(packed, (F.col("doc") == F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left")
    whole = F.col("doc") > F.col("first")
    return out.select("doc_id", "text", F.coalesce(whole, F.lit(False)).alias("whole"), "stretches")


def digest(docs: DataFrame, width: int = 100, batches: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = []
            for text, whole, stretches in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = (text.as_py() or "").encode()
                spans = [[0, len(raw)]] if whole else _cut_spans(stretches, width)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed_spans(docs, width, batches).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
