"""Hard-negative mining by a secondary-sort shuffle.

Scores of (anchor, row) pairs are packed into keys (anchor, descending score, kind,
id), dealt out by anchor and sorted within each partition.  A streaming iterator
then reads an anchor's pairs best first: each of the first rows of the anchor's own
label opens a window of scores, and rows of other labels that fall into open
windows are emitted, as many as each window takes.  No anchor's pairs are ever held
together; what is held are the windows of the one anchor being read.

A window begins below its positive's score, so in sorted order every positive
comes before all that can fall into its window (kind puts it first at equal scores).

Pre-aggregation before the shuffle loses nothing: of a task's rows only the
anchor's best ones of its label can be positives, and, with the positives known,
only the first rows of each window can be emitted.  So a task sends at most
``positives * (1 + negatives)`` keys for an anchor, whatever the labels' sizes, and
no vector is shuffled.  Anchors are the stated query set; they meet all rows block
by block, a bounded part of them in each scan.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: anchors that a scan of the rows holds (a broadcast of 8 bytes a component); more take further scans
ANCHORS = 16_384
#: anchors and rows whose scores are computed at a time
ANCHOR_BLOCK, ROW_BLOCK = 512, 4096
#: tasks of a scan at most, as each sends some keys for each anchor
SCAN_TASKS = 1024
KEY = struct.Struct(">QQBQ")
BIAS = 1 << 63
#: scores below this are exact in doubles
EXACT = 1 << 53
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles) of rows that have an id, a label and finite components."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    return v.filter("vec_id is not null and label is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as integers of any size."""
    out = np.floor(scale * flat)
    return out if not len(out) or np.abs(out).max() < EXACT else np.array([int(x) for x in out], object)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices, exact; an error if one does not fit into 64 bits."""
    if a.dtype != object and b.dtype != object:
        bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
        if bound < EXACT:
            return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.array([[sum(x * y for x, y in zip(p, q)) for q in whole(b)] for p in whole(a)], object).astype(np.int64).reshape(len(a), len(b))


class Best:
    """The first ``most`` (score, id, row) of each group, best score first, ties by id and then row."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.group = self.score = self.id = self.row = np.zeros(0, np.int64)
        self.least = np.full(groups, np.iinfo(np.int64).min)  # score of a full group's last one

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        g, s, i, r = (np.concatenate(x) for x in ((self.group, group), (self.score, score), (self.id, ids), (self.row, row)))
        by = np.lexsort((r, i, ~s, g))  # ~s descends as s ascends, without overflow
        g, s, i, r = g[by], s[by], i[by], r[by]
        turn = np.arange(len(g)) - np.searchsorted(g, g)
        on = turn < self.most
        last = turn == self.most - 1
        self.least[g[last]] = s[last]
        self.group, self.score, self.id, self.row = g[on], s[on], i[on], r[on]


def _enough(score: np.ndarray, may: np.ndarray, most: int, least: np.ndarray) -> np.ndarray:
    """Those of ``may`` (anchors x rows) that can be among the first ``most`` of their anchor."""
    low = np.iinfo(np.int64).min
    if score.shape[1] > most:
        masked = np.where(may, score, low)
        nth = np.partition(masked, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
        least = np.maximum(least, nth)
    return may & (score >= least[:, None])


class Anchors:
    """Anchors of one vector length, and the windows of their positives."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.id, self.label, self.vector = ids, labels, vectors
        self.windows: list[tuple[np.ndarray, np.ndarray]] = []  # (lowest, highest score) of each anchor

    def open(self, anchor: np.ndarray, score: np.ndarray, turn: np.ndarray, most: int, low: int, high: int) -> None:
        """Windows low/100 to high/100 of the positives' scores; an anchor without one has an empty window."""
        at = np.argsort(self.id)
        place = at[np.searchsorted(self.id, anchor, sorter=at)]
        for k in range(most):
            lo, hi = np.ones(len(self.id), np.int64), np.zeros(len(self.id), np.int64)
            on = turn == k
            lo[place[on]] = [-(-low * s // 100) for s in score[on].tolist()]
            hi[place[on]] = [high * s // 100 for s in score[on].tolist()]
            self.windows.append((lo, hi))


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(vector length, ids, labels, vectors, row numbers) of the batches' rows."""
    seen = 0
    for batch in batches:
        for a in range(0, batch.num_rows, block):
            part = batch.slice(a, block)
            size = part.column(2).value_lengths().to_numpy()
            flat = part.column(2).flatten().to_numpy()
            first = np.cumsum(size) - size
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            for n in np.unique(size):
                on = np.flatnonzero(size == n)
                values = integers(flat[(first[on][:, None] + np.arange(n)).reshape(-1)], scale)
                yield int(n), ids[on], labels[on], values.reshape(len(on), n), seen + a + on
        seen += batch.num_rows


def _scan(rows: DataFrame, anchors, scale: int, most: int, negatives: int | None) -> DataFrame:
    """(anchor_id, score, vec_id) of what a task's rows may be for each anchor: its best positives, or the first of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], Best] = {}
        for n, ids, labels, vectors, row in _blocks(batches, scale, ROW_BLOCK):
            own = anchors.value.get(n)
            for a in range(0, len(own.id) if own else 0, ANCHOR_BLOCK):
                me = slice(a, a + ANCHOR_BLOCK)
                score = scores(own.vector[me], vectors)
                same = own.label[me][:, None] == labels[None, :]
                if negatives is None:
                    fine = [same & (own.id[me][:, None] != ids[None, :])]
                else:
                    fine = [~same & (score >= lo[me][:, None]) & (score <= hi[me][:, None]) for lo, hi in own.windows]
                for k, may in enumerate(fine):
                    best = held.setdefault((n, a, k), Best(len(own.id[me]), negatives or most))
                    i, j = np.nonzero(_enough(score, may, best.most, best.least))
                    if len(i):
                        best.add(i, score[i, j], ids[j], row[j])
        for n in sorted({k[0] for k in held}):
            got = [(anchors.value[n].id[a + b.group], b.score, b.id, b.row) for (m, a, _), b in held.items() if m == n]
            anchor, score, ids, row = (np.concatenate(x) for x in zip(*got))
            # a row may be among the first of several windows
            once = np.unique(np.stack((anchor, row)), axis=1, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (anchor, score, ids)], ["anchor_id", "score", "vec_id"])

    return rows.coalesce(SCAN_TASKS).mapInArrow(run, "anchor_id long, score long, vec_id long")


def packed(anchor: int, score: int, kind: int, vec_id: int) -> bytes:
    """A key whose order as bytes is (anchor, score descending, kind, id)."""
    return KEY.pack(anchor + BIAS, BIAS - 1 - score, kind, vec_id + BIAS)


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, vec_id = KEY.unpack(key)
    return anchor - BIAS, BIAS - 1 - score, kind, vec_id - BIAS


def windows_of(keys: Iterator[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Streams sorted keys: positives (kind 0) open windows, others are emitted into those they fall into."""
    current, opened = None, []
    for key in keys:
        anchor, score, kind, vec_id = unpacked(key)
        if anchor != current:
            current, opened = anchor, []
        if kind == 0:
            if len(opened) < positives:
                opened.append([vec_id, score, 0])
            continue
        for window in opened:
            if window[2] < negatives and low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor, window[0], window[2], vec_id, window[1], score


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Hard negatives of each anchor (vec_id divisible by ``every``) and positive.

    Components become floor(scale * x); a row's score is its integer inner product with
    the anchor, higher ones first, ties to the smaller vec_id.  An anchor's positives
    are its first other rows of the same label; of each, the first rows of another label whose
    score lies between ``low`` and ``high`` percent of the positive's score are returned:
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or with a null or non-finite component, take
    no part.  Vectors of different lengths are not compared.  Repeated rows (one vec_id)
    are candidates each, never for their own id; of repeated anchors the one
    that is smallest by label and then vector asks.  A score that does not fit into 64 bits is an error.
    An empty table, or one without anchors, gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    asking = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.label", "a.vector")
    asking = staged(asking, "anchors")
    parts = max(1, -(-asking.count() // ANCHORS))
    share = lambda t, p: t if parts == 1 else t.filter(F.pmod(F.xxhash64(t.columns[0]), F.lit(parts)) == p)

    def held(p: int) -> dict[int, Anchors]:
        """The anchors of a part by vector length."""
        table = share(asking, p).toArrow().combine_chunks()
        out: dict[int, list] = {}
        for batch in table.to_batches():
            for n, ids, labels, values, _ in _blocks(iter([batch]), scale, ROW_BLOCK):
                out.setdefault(n, []).append((ids, labels, values))
        return {n: Anchors(*(np.concatenate(x) for x in zip(*got))) for n, got in out.items()}

    both = lambda made: [made(p) for p in range(parts)]
    union = lambda tables: tables[0] if len(tables) == 1 else tables[0].union(union(tables[1:]))
    near = union(both(lambda p: _scan(rows, spark.sparkContext.broadcast(held(p)), scale, positives, None)))
    turn = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")) - 1
    chosen = staged(near.withColumn("turn", turn).filter(F.col("turn") < positives), "positives")

    def opened(p: int):
        anchors, known = held(p), share(chosen, p).toArrow()
        anchor, score, nth = (known[c].to_numpy() for c in ("anchor_id", "score", "turn"))
        for a in anchors.values():
            on = np.isin(anchor, a.id)
            a.open(anchor[on], score[on], nth[on], positives, low, high)
        return spark.sparkContext.broadcast(anchors)

    inside = union(both(lambda p: _scan(rows, opened(p), scale, positives, negatives)))
    pairs = chosen.select("anchor_id", "score", F.lit(0).alias("kind"), "vec_id").union(inside.select("anchor_id", "score", F.lit(1), "vec_id"))
    keys = pairs.rdd.map(lambda r: (packed(*r), None))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8]))
    found = ordered.mapPartitions(lambda part: windows_of((k for k, _ in part), positives, negatives, low, high))
    return spark.createDataFrame(found, OUT, verifySchema=False)
