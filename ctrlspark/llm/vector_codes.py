"""Vector code compression: a codebook for each part of the vectors, searched by Orchard's method.

Vectors become integers and are cut into equal parts.  Each part position has a
codebook of a few entries, improved in rounds: every part is assigned to its nearest
entry, and each entry becomes the floor of the mean of its parts.

Orchard's search keeps, for every entry, a list of the others sorted by distance.
A part starts at one entry and walks its list; an entry that is nearer takes
over, and the walk goes on in that one's list.  Entries looked at are marked and
never measured twice.  When the next entry of the list is more than twice as far
from the current one as the part is, all that follow are farther from the
part than the current entry (triangle inequality), and the search stops.  At exactly twice
it goes on, as an equally near entry of lower index may follow.

Spark partitions the vectors; a round is one scan with the codebooks (a fixed
number of entries) broadcast, and returns sums and counts of each entry, added up
in two steps.  All arithmetic is in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hard_negatives import EXACT
from .staging import staged

#: rows from which a label is hot: its sum is broadcast (at most one row for each so many vectors), the others' are joined by shuffle
HOT_ROWS = 100_000
#: rows worked on at a time
BLOCK = 8192


class Codebook:
    """Entries (entries x components) of one part position, and the sorted neighbour list of each."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(apart, axis=1, kind="stable")
        own = np.arange(len(entries))
        self.near = order[order != own[:, None]].reshape(len(entries), -1)
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def measure(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = points - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, ties to the lower index; squared distance) of each point: Orchard's search, all points side by side."""
        n, k = len(points), len(self.entries)
        best = np.zeros(n, np.int64)
        error = self.measure(points, best)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)  # place in the current entry's list
        going = np.arange(n) if k > 1 else np.zeros(0, np.int64)
        while len(going):
            here, place = best[going], at[going]
            going = going[self.apart[here, place] <= 4 * error[going]]  # distances are squared
            here, place = best[going], at[going]
            entry = self.near[here, place]
            at[going] += 1
            fresh = ~seen[going, entry]
            who, entry = going[fresh], entry[fresh]
            seen[who, entry] = True
            found = self.measure(points[who], entry)
            nearer = (found < error[who]) | (found == error[who]) & (entry < best[who])
            who, entry = who[nearer], entry[nearer]
            best[who], error[who], at[who] = entry, found[nearer], 0
            going = going[at[going] < k - 1]
        return best, error


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector of rows whose vector is there, not empty, and finite."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector"))
    return v.filter("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors; an error beyond what squared sums in 64 bits can take."""
    size = len(vectors[0]) if len(vectors) else 0
    out = np.floor(scale * vectors.flatten().to_numpy().astype(np.float64)).reshape(len(vectors), size)
    if len(out) and 4 * size * float(np.abs(out).max()) ** 2 >= EXACT:
        raise ValueError("components too large: squared distances would not be exact")
    return out.astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], column: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield part, _matrix(part.column(column), scale)


def _assigned(books: list[Codebook], values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, entry, squared distance) of each part position."""
    width = values.shape[1] // len(books)
    for p, book in enumerate(books):
        points = np.ascontiguousarray(values[:, p * width : (p + 1) * width])
        yield points, *book.nearest(points)


def _round(rows: DataFrame, books: Broadcast, scale: int) -> list:
    """(part, entry, sums of components, count) of every entry that is used: at most parts x entries rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [Codebook(b) for b in books.value]
        sums, counts = np.zeros((len(mine), len(mine[0].entries), mine[0].entries.shape[1]), np.int64), np.zeros((len(mine), len(mine[0].entries)), np.int64)
        for _, values in _batches(batches, 0, scale):
            for p, (points, entry, _) in enumerate(_assigned(mine, values)):
                np.add.at(sums[p], entry, points)
                counts[p] += np.bincount(entry, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        width = sums.shape[2]
        grid = lambda x: pa.array(np.repeat(x, width))
        yield pa.RecordBatch.from_arrays([grid(part), grid(entry), pa.array(np.tile(np.arange(width), len(part))), pa.array(sums[part, entry].reshape(-1)), grid(counts[part, entry])], ["part", "entry", "place", "total", "n"])

    partial = rows.select("vector").mapInArrow(run, "part long, entry long, place long, total long, n long")
    return partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """Final entries (parts x entries x components) of ``rows(vec_id, vector)``; there may be fewer rows than entries."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(0, np.int64)
        for batch in batches:
            least = np.unique(np.concatenate((least, batch.column(0).to_numpy())))[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(least)], ["vec_id"])

    ids = rows.select("vec_id").filter("vec_id is not null").mapInArrow(smallest, "vec_id long").distinct().orderBy("vec_id").limit(entries)
    ids = [r.vec_id for r in ids.collect()]
    first = rows.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id")
    start = _matrix(first.select("vector").toArrow()["vector"].combine_chunks(), scale)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _round(rows, rows.sparkSession.sparkContext.broadcast(books), scale):
            books[r.part, r.entry, r.place] = r.total // r.n
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every usable vector; the codebooks).

    ``code`` has two hexadecimal digits for each part; ``error`` is the squared distance
    of the integer vector to its entries.  ``entries`` is at most 256.

    Rows whose vector is null or empty or holds a null or non-finite component are dropped.
    The first codebooks are the parts of the smallest vec_ids, of repeated ones the smallest vector; fewer
    than ``entries`` ids make smaller codebooks.  Rows with a null vec_id have codes but start no entry (if no row
    has an id, nothing is returned).  All vectors must have the first one's length, divisible by
    ``parts``; others take no part.  Repeated rows count each.  An empty table
    gives no rows and no entries; other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits: at most 256 entries")
    usual = usable(vectors)
    lead = usual.filter("vec_id is not null").agg(F.min(F.struct("vec_id", F.size("vector").alias("size")))["size"]).first()[0]
    if lead is not None and lead % parts:
        raise ValueError(f"vectors of {lead} components can't be cut into {parts} equal parts")
    rows = staged(usual.filter(F.size("vector") == (lead or 0)), "vectors")
    out = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if lead is None:
        return rows.selectExpr("vec_id", "label", "'' as code", "0L as error"), np.zeros((parts, 0, 0), np.int64)
    books = codebooks(rows, parts, entries, rounds, scale)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [Codebook(b) for b in shared.value]
        for batch, values in _batches(batches, 2, scale):
            code, error = np.zeros((len(values), len(mine)), np.uint8), np.zeros(len(values), np.int64)
            for p, (_, entry, apart) in enumerate(_assigned(mine, values)):
                code[:, p] = entry
                error += apart
            raw = code.tobytes().hex()
            width = 2 * len(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, out), books


def reconstruct(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """vec_id, embedding: the vectors that codes stand for."""
    parts, entries, width = books.shape
    table = [[float(x) / scale for x in e] for b in books for e in b]
    lookup = F.array(*(F.array(*map(F.lit, e)) for e in table))
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * entries
    return codes.select("vec_id", F.flatten(F.array(*(F.get(lookup, at(p)) for p in range(parts)))).alias("embedding"))


def codebooks_hash(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def digest(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, null ones together), codebooks_sha256."""
    made = staged(codes, "codes")
    total = made.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    hot = F.broadcast(staged(total.filter(F.col("__n") >= HOT_ROWS), "hot"))
    same = F.col("label").eqNullSafe(F.col("__label"))
    rest = made.join(hot, same, "left_anti").join(total.filter(F.col("__n") < HOT_ROWS), same)
    joined = made.join(hot, same).unionByName(rest)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256"))
