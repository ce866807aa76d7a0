"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and benchmark items become word sequences.  The patterns are an item's
windows of ``width`` consecutive words; an item of fewer words is one pattern.
For each pattern length a shift table over blocks of two words tells how far the
search may jump: a block that ends no pattern prefix lets it skip a whole
pattern.  Where the shift is 0, the hash of that last block selects a bucket of
patterns (all that end with it); of these, the ones whose words have the window's
hash are compared byte for byte.

The search runs for all documents of a chunk at once, one cursor each.  A
benchmark of any size is dealt into parts of bounded length; a scan of the
documents holds ``PARTS_AT_ONCE`` of them at most, and what several scans find is
put together by document.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .staging import staged

#: characters of benchmark text in a part, about (a longer item is a part of its own), and parts that a scan holds
PART_CHARS, PARTS_AT_ONCE = 2_000_000, 4
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Patterns:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray):
        """``hashes``: one row of word hashes for each pattern; its bytes lie from ``start`` to ``end``, it is of ``item``."""
        self.length, self.block = length, min(2, length)
        suffix = combine(hashes[:, length - self.block :])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.full = suffix[order], combine(hashes)[order]
        self.start, self.end, self.item = start[order], end[order], item[order]
        keys, shifts = [], []
        for at in range(self.block, length + 1):
            keys.append(combine(hashes[:, at - self.block : at]))
            shifts.append(np.full(len(hashes), length - at))
        key, shift = np.concatenate(keys), np.concatenate(shifts)
        by = np.lexsort((shift, key))
        self.blocks, first = np.unique(key[by], return_index=True)
        self.shifts = shift[by][first]  # the smallest shift of a block
        self.default = length - self.block + 1

    def search(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start words, pattern numbers) of a bucket's patterns whose hash is the window's."""
        at, pattern = [], []
        ends = first[1:]
        cursor = first[:-1] + self.length - 1  # the word that a pattern would end at
        limit = ends[cursor < ends]
        cursor = cursor[cursor < ends]
        while len(cursor):
            key = combine(np.stack([h[cursor - self.block + 1 + i] for i in range(self.block)], axis=1))
            i = np.minimum(np.searchsorted(self.blocks, key), len(self.blocks) - 1)
            jump = np.where(self.blocks[i] == key, self.shifts[i], self.default)
            hit = np.flatnonzero(jump == 0)
            if len(hit):
                start = cursor[hit] - self.length + 1
                full = combine(h[start[:, None] + np.arange(self.length)])
                low, high = np.searchsorted(self.suffix, key[hit], "left"), np.searchsorted(self.suffix, key[hit], "right")
                bucket, of = textvec.ragged(low, high - low), np.repeat(np.arange(len(hit)), high - low)
                same = self.full[bucket] == full[of]
                at.append(start[of[same]])
                pattern.append(bucket[same])
            cursor = cursor + np.maximum(jump, 1)
            on = cursor < limit
            cursor, limit = cursor[on], limit[on]
        none = np.zeros(0, np.int64)
        return (np.concatenate(at), np.concatenate(pattern)) if at else (none, none)


class Part:
    """Patterns of some items, by length, with the items' ids and words."""

    def __init__(self, ids: list[str | None], texts: list[str | None], width: int):
        self.ids = ids
        plain = [b" ".join(split_words(t)) for t in texts]
        self.text = b"".join(plain)
        buf = np.frombuffer(self.text, np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(x) for x in plain]))).astype(np.int64)
        h, start, end, first = textvec.words(buf, offs, textvec.ALNUM)
        size = np.diff(first)
        self.groups = []
        for n in np.unique(np.minimum(size[size > 0], width)).tolist():
            items = np.flatnonzero(np.minimum(size, width) == n)
            count = size[items] - n + 1
            at = textvec.ragged(first[items], count)
            self.groups.append(Patterns(n, h[at[:, None] + np.arange(n)], start[at], end[at + n - 1], np.repeat(items, count)))


def combine(h: np.ndarray) -> np.ndarray:
    """One hash for each row of word hashes."""
    return textvec.mix((h * textvec.steps(h.shape[1])[1:]).sum(axis=1, dtype=np.uint64))


def split_words(text: str | None) -> list[bytes]:
    return _WORD.findall(textvec.fold(np.frombuffer((text or "").encode(), np.uint8)).tobytes())


def pattern_parts(benchmark: DataFrame, width: int, part_chars: int) -> list[list[Broadcast]]:
    """Broadcast parts of the benchmark's items, in groups that one scan holds.

    A part's items are fetched and compiled at a time; its length is about
    ``part_chars`` characters, whatever the size of the benchmark.
    """
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // part_chars))
    items = items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    if n > 1:
        items = staged(items.repartition("part"), "items")
    parts = []
    for k in range(n):
        got = items.filter(F.col("part") == k).select("i", "t").toArrow()
        parts.append(context.broadcast(Part(got["i"].to_pylist(), got["t"].to_pylist(), width)))
    return [parts[k : k + PARTS_AT_ONCE] for k in range(0, n, PARTS_AT_ONCE)]


def search_chunk(parts: list[Broadcast], buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]], list[list[dict]]]:
    """(words, hit words, item ids, hit runs) of each document of a chunk; a run has words and bytes from start to end."""
    h, starts, ends, first = textvec.words(buf, offs, textvec.ALNUM)
    cover = np.zeros(len(h) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    folded = textvec.fold(buf)
    for part in (p.value for p in parts):
        for group in part.groups:
            at, pattern = group.search(h, first)
            doc = np.searchsorted(first, at, "right") - 1
            for a, p, d in zip(at.tolist(), pattern.tolist(), doc.tolist()):
                here = b" ".join(folded[starts[k] : ends[k]].tobytes() for k in range(a, a + group.length))
                if here == part.text[group.start[p] : group.end[p]]:
                    cover[a] += 1
                    cover[a + group.length] -= 1
                    name = part.ids[group.item[p]]
                    items[d] |= {name} if name is not None else set()
    hit = np.cumsum(cover[:-1]) > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    runs: list[list[dict]] = [[] for _ in offs[1:]]
    for d in items:
        own = np.concatenate(([False], hit[first[d] : first[d + 1]], [False]))
        edge = np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)
        runs[d] = [{"first": int(a), "last": int(b), "start": int(starts[first[d] + a] - offs[d]), "end": int(ends[first[d] + b - 1] - offs[d])} for a, b in edge]
    return np.diff(first), total[first[1:]] - total[first[:-1]], items, runs


RUNS = "array<struct<first: long, last: long, start: long, end: long>>"


def _scan(docs: DataFrame, parts: list[Broadcast]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))

    def find(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        n_words, n_hit, items, runs = search_chunk(parts, buf, offs)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(items.get(d, ())) for d in range(len(n_words))], pa.list_(pa.string())), pa.array(runs, run)],
            ["doc_id", "text_key", "n_words", "n_hit", "item_ids", "runs"],
        )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return textvec.per_chunk(keyed, find, f"doc_id {kind}, text_key long, n_words long, n_hit long, item_ids array<string>, runs {RUNS}", ("doc_id", "text_key", "text"))


#: SQL: runs of several scans, sorted by first, with those that meet made one
_UNITED = f"""aggregate(array_sort(flatten(collect_list(runs))), cast(array() as {RUNS}), (done, x) ->
  case when size(done) = 0 or element_at(done, -1).last < x.first then concat(done, array(x))
  else concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, x.last),
    'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, x.end)))) end)"""


def _found(docs: DataFrame, benchmark: DataFrame, width: int, part_chars: int) -> DataFrame:
    groups = pattern_parts(benchmark, width, part_chars)
    scans = [_scan(docs, g) for g in groups]
    if len(scans) == 1:
        return scans[0]
    # the first scan has every row; of the others those count that found something
    base = scans[0].withColumn("scan", F.lit(0))
    for k, more in enumerate(scans[1:], 1):
        base = base.unionByName(more.filter("n_hit > 0").withColumn("scan", F.lit(k)))
    per = base.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.expr(_UNITED).alias("runs"), F.count(F.when(F.col("scan") == 0, 1)).alias("copies"))
    hit = F.expr("aggregate(runs, 0L, (n, x) -> n + x.last - x.first)").alias("n_hit")
    return per.withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("doc_id", "text_key", "n_words", hit, "item_ids", "runs")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 13, part_chars: int = PART_CHARS) -> DataFrame:
    """Words of documents that lie inside occurrences of benchmark windows.

    Returns one row per document: doc_id, n_words, n_hit, item_ids (sorted
    strings), spans (start and end byte of each run of hit words).  The benchmark
    is a stated set of queries; a small one is searched for in one scan of the
    documents.  Null texts have no words; an item with a null id hits words, but is
    not listed; repeated rows count each; an empty benchmark hits nothing, an
    empty table gives no rows; other columns are ignored.
    """
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans")
    return _found(docs, benchmark, width, part_chars).select("doc_id", "n_words", "n_hit", "item_ids", spans)


def digest(found: DataFrame, share: int = 20) -> DataFrame:
    """The contract's columns from ``hits``; contaminated: some word is hit, and at least one in ``share``."""
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), dirty.alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, part_chars: int = PART_CHARS) -> DataFrame:
    """``docs`` without contaminated rows; every other row keeps all its columns.

    Null, empty and wordless texts stay; repeated rows stay or go together; null
    doc_ids are judged by their text; an empty benchmark or table changes nothing.
    No shuffle, unless the benchmark needs several scans.
    """
    groups = pattern_parts(benchmark, width, part_chars)
    if len(groups) > 1:
        bad = _found(docs, benchmark, width, part_chars).filter((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"]), "left_anti")

    def keep(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        n_words, n_hit, _, _ = search_chunk(groups[0], buf, offs)
        yield rows.filter(pa.array((n_hit == 0) | (n_hit * share < n_words)))

    return textvec.per_chunk(docs, keep, docs.schema, tuple(docs.columns))
