"""Approximate nearest neighbours by a forest of hash prefixes.

Vectors are dealt to blocks at random.  A block holds, for each tree, its
vectors' hash strings (signs of random projections, as long integers) as a sorted
array.  A query descends in each tree to its longest matching prefix and then
ascends in all trees at once, a bit at a time, until the vectors that share the
prefix in some tree are enough; these get their exact cosines.  Each block
returns a query's nearest, and the best of all blocks stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS = 40, 32
#: distinct vectors in a block, about
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 4096
#: a query looks at this share of a block's distinct vectors, and at no fewer than LEAST
SHARE, LEAST = 0.4, 400


def hash_strings(unit: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """One integer of ``bits`` bits for each vector and tree, the first projection in the highest bit."""
    planes = np.random.default_rng(7).standard_normal((unit.shape[1], trees * bits))
    signs = (unit @ planes > 0).reshape(len(unit), trees, bits)
    return (signs.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=2)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors times powers of two that bring their largest component near 1, their norms): exact, and no square overflows."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    small = np.ldexp(vectors, -exponent[:, None])
    return small, np.sqrt((small * small).sum(axis=1))


class Forest:
    """Sorted hash strings of a block's distinct vectors."""

    def __init__(self, vectors: np.ndarray, share: float, least: int):
        self.vectors, self.norm = scaled(vectors)
        codes = hash_strings(self.vectors / self.norm[:, None])
        self.order = np.argsort(codes, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(codes, self.order.T, axis=0).T
        self.target = min(len(vectors), max(least, int(np.ceil(share * len(vectors)))))

    def candidates(self, codes: np.ndarray) -> list[np.ndarray]:
        """Row numbers that each query (its codes by tree) looks at."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(codes)
        depth = np.max([self.descend(t, codes[:, t]) for t in range(TREES)], axis=0)
        waiting = np.arange(len(codes))
        active = np.zeros(0, np.int64)
        for shift in range(BITS + 1):  # ascend: prefixes lose a bit in all trees
            reached = depth[waiting] >= BITS - shift
            active, waiting = np.concatenate((active, waiting[reached])), waiting[~reached]
            if not len(active):
                continue
            low = (codes[active] >> shift) << shift
            lo = np.stack([np.searchsorted(self.sorted[t], low[:, t]) for t in range(TREES)], axis=1)
            hi = np.stack([np.searchsorted(self.sorted[t], low[:, t] + (1 << shift)) for t in range(TREES)], axis=1)
            may = np.flatnonzero((hi - lo).sum(axis=1) >= self.target)
            done = np.zeros(len(active), bool)
            for i in may:
                mark = np.zeros(len(self.vectors), bool)
                for t in range(TREES):
                    mark[self.order[t, lo[i, t] : hi[i, t]]] = True
                rows = np.flatnonzero(mark)
                if len(rows) >= self.target:
                    found[active[i]], done[i] = rows, True
            active = active[~done]
            if not len(active) and not len(waiting):
                break
        return found

    def descend(self, tree: int, codes: np.ndarray) -> np.ndarray:
        """Length of the longest prefix of each code that the tree holds: one of its neighbours in order has it."""
        names = self.sorted[tree]
        at = np.searchsorted(names, codes)
        apart = np.minimum(codes ^ names[np.minimum(at, len(names) - 1)], codes ^ names[np.maximum(at - 1, 0)])
        return BITS - np.frexp(apart.astype(np.float64))[1]


def _search(index: pd.DataFrame, queries: pd.DataFrame, k: int, share: float, least: int) -> pd.DataFrame:
    if not len(index) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    vectors = np.stack(index["vector"].to_list()).astype(np.float64)
    distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
    # of equal vectors the k + 1 smallest ids can be among a query's nearest
    own = pd.DataFrame({"group": inverse.reshape(-1), "vec_id": index["vec_id"]}).sort_values(["group", "vec_id"])
    own = own[own.groupby("group").cumcount() <= k]
    start = np.searchsorted(own["group"].to_numpy(), np.arange(len(distinct) + 1))
    ids = own["vec_id"].to_numpy()
    forest = Forest(distinct, share, least)
    wanted, norm = scaled(np.stack(queries["vector"].to_list()).astype(np.float64))
    out = []
    for q, rows in enumerate(forest.candidates(hash_strings(wanted / norm[:, None]))):
        score = (forest.vectors[rows] * wanted[q]).sum(axis=1) / (forest.norm[rows] * norm[q])
        best = rows[np.argsort(-score, kind="stable")]
        score = np.sort(score)[::-1]
        take = score >= score[min(k, len(score) - 1)]  # ties with the last one come along
        me = queries["vec_id"].iloc[q]
        got = [(me, int(i), s) for r, s in zip(best[take], score[take]) for i in ids[start[r] : start[r + 1]] if i != me]
        got.sort(key=lambda x: (-x[2], x[1]))
        out += got[:k]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) and dim of vectors that have a cosine: no null, no non-finite component, not zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = "vec_id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    return v.filter(fine).withColumn("dim", F.size("vector"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The ``k`` nearest found of each query (vec_id divisible by ``every``) among all other rows.

    Returns query_id, rank (from 1), vec_id, score (cosine in doubles); ties go to
    the smaller vec_id.  Null vectors, zero ones and those with null or non-finite
    components take no part, nor do rows with a null vec_id; vectors of different
    lengths are not compared; repeated rows (one vec_id) are candidates each, but
    never of their own id, and one of them asks; an empty table gives none; other columns are ignored.

    Index blocks meet the query set block by block; no list of candidates leaves a task.
    """
    rows = usable(vectors)
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    blocks, parts = max(1, -(-sizes["n"] // BLOCK_VECTORS)), max(1, -(-sizes["q"] // BLOCK_QUERIES))
    key = ["dim", "block", "part"]
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    index = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(numbers(parts)))
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("block", F.explode(numbers(blocks)))
    found = index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(lambda i, q: _search(i, q, k, share, least), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
