"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(src long, dst long)``; component is one of its nodes.

    In each round every node moves to the neighbour (or itself) of the lowest
    random rank and then to where that one moved; edges between moved nodes go
    on, until none is left.  Ranks are a hash of the node and the round, so
    chains shrink by a constant factor a round.  Edges and labels stay in tables;
    a round's result is written to the shared folder, so that lineage stays short.
    """
    clean = edges.filter("src <> dst")
    both = staged(clean.select("src", "dst").union(clean.select("dst", "src")).distinct(), "edges")
    labels, turn = None, 0
    while both.head(1):
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("node"))  # noqa: B023,E731
        up = both.groupBy("src").agg(F.min(rank("dst")).alias("low"))
        up = staged(up.select("src", F.when(F.col("low") < rank("src"), F.col("low.node")).otherwise(F.col("src")).alias("up")), "up")
        over = up.select(F.col("src").alias("up"), F.col("up").alias("over"))
        moved = staged(up.join(over, "up").select("src", F.col("over").alias("to")), "moved")
        if labels is None:
            labels = moved.select(F.col("src").alias("node"), F.col("to").alias("component"))
        else:
            stay = labels.join(moved, F.col("component") == F.col("src"), "left")
            labels = staged(stay.select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = moved.select(F.col("src").alias("dst"), F.col("to").alias("dst_to"))
        both = both.join(moved, "src").join(ends, "dst").filter("to <> dst_to").select(F.col("to").alias("src"), F.col("dst_to").alias("dst")).distinct()
        both = staged(both, "edges")
        turn += 1
    if labels is None:
        return clean.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    return labels
