"""N-gram Jaccard join as a blocked sparse product of the document by n-gram matrix.

Rows of the matrix are distinct n-gram sets (copies share a row), columns are
n-grams.  The product of the matrix with its transpose holds the overlap counts;
only those that can reach the threshold are accumulated:

1. Row filter.  If two sets of sizes a and b have Jaccard t, each lacks at most
   p - 1 of its own columns in the other, where p = a - ceil(t a) + 1.  A row's head
   is the k = min(a, 2 p - 1) columns that come first in a random order.  The m-th
   shared column stands at place m + p - 1 of either row at the latest, so both heads
   hold the first k - p + 1 shared ones, by the p and k of the smaller row, whose
   size is ceil(t a) at least.  Rows with fewer columns in common with all other
   rows' heads are alone.
2. Rarity prefix.  Of the rows left, columns are counted and ordered by rarity.
   Columns of one row only come first and cost nothing; a linked pair shares one
   of its first p columns.  Rows that meet in such a column go to one cluster.
3. Hubs.  Rows of a cluster are cut by size class, because sizes of a linked pair
   differ by the factor t at most.  A class of many blocks is multiplied by one of its
   blocks first: near copies of one template are mostly linked through that, and
   rows that are linked already (a part) need not meet again.
4. Blocks.  Rows of a class are dealt to blocks of bounded rows and cells, a large
   part to blocks of its own.  Each pair of blocks of equal or adjacent classes is
   one sparse product, but for two blocks of one part; counts below
   ceil(t (a + b) / (1 + t)) are dropped, and of the links a block pair keeps a
   spanning forest.

Components of the forests' links are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .components import connected_components
from .staging import staged

#: rows and n-gram cells in a block of the product (more cells only where one row has them)
BLOCK_ROWS, BLOCK_CELLS = 256, 2_000_000
#: a size class of more blocks than this meets one of them first
HUB_BLOCKS = 4
#: copies of one set are split by this many keys
SALTS = 64
#: keys that are broadcast to pick rows out of the texts; more of them are joined by shuffle
BROADCAST_KEYS = 2_000_000


def _ceil_share(share: Fraction, n: np.ndarray) -> np.ndarray:
    return -(-n * share.numerator // share.denominator)


def _head(share: Fraction, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns of a row's head, how many of them the head of a linked row holds at least).

    The second grows with the size, so that the smallest partner's bounds that of all.
    """
    least = _ceil_share(share, size)
    k = lambda n: np.where(n > 0, np.minimum(n, 2 * (n - _ceil_share(share, n)) + 1), 0)
    return k(size), k(least) - (least - _ceil_share(share, least))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def set_marks(grams: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for seed in (0x51ED2701, 0xA3B1956F):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(textvec.mix(grams ^ np.uint64(seed)), out=total[1:])
        out.append(textvec.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out


def shingle_sets(docs: DataFrame, n: int, share: Fraction) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, set_a, set_b (128 bits of the set), need, head.

    ``head``: the set's first columns in hash order; ``need``: how many of them a partner's head shares.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def build(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, _, _, first = textvec.words(buf, offs, textvec.NON_BLANK)
        grams, at = textvec.shingle_hashes(h, first, n)
        size = np.diff(at)
        a, b = set_marks(grams, at)
        k, need = _head(share, size)
        head = grams[textvec.ragged(at[:-1], k)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(k))), pa.int32()), pa.array(_signed(head)))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(size, pa.int64()), pa.array(_signed(a)), pa.array(_signed(b)), pa.array(need, pa.int64()), lists], ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "need", "head"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return textvec.per_chunk(keyed, build, f"doc_id {kind}, text_key long, n_shingles long, set_a long, set_b long, need long, head array<long>", ("doc_id", "text_key", "text"))


def whole_sets(docs: DataFrame, n: int) -> DataFrame:
    """set_a, set_b, size and all n-gram columns of each document."""

    def build(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, _, _, first = textvec.words(buf, offs, textvec.NON_BLANK)
        grams, at = textvec.shingle_hashes(h, first, n)
        size = np.diff(at)
        a, b = set_marks(grams, at)
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_signed(grams)))
        yield pa.RecordBatch.from_arrays([pa.array(_signed(a)), pa.array(_signed(b)), pa.array(size), lists], ["set_a", "set_b", "size", "columns"])

    return textvec.per_chunk(docs, build, "set_a long, set_b long, size long, columns array<long>", ("text",))


def _candidates(sets: DataFrame) -> DataFrame:
    """Texts of the rows that may have a partner (a superset): text_key."""
    rows = sets.filter("n_shingles > 0").select("row", "set_a", F.explode("head").alias("column"))
    shared = rows.groupBy("column").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).filter("low <> high").select("column")
    met = rows.select("row", "column").join(shared, "column").groupBy("row").agg(F.count("*").alias("met"))
    return sets.select("row", "need", "text_key", "set_a", "set_b").join(met, "row").filter("met >= need").groupBy("set_a", "set_b").agg(F.min("text_key").alias("text_key")).select("text_key").distinct()


def _links(pdf: pd.DataFrame, share: Fraction) -> pd.DataFrame:
    """Spanning forest of the links of one pair of blocks."""
    pdf = pdf.sort_values(["side", "node"], ignore_index=True)
    pdf = pdf.drop_duplicates(["node", "side"], ignore_index=True)
    left, right = pdf[pdf["side"] != 2], pdf[pdf["side"] != 1]
    if not len(left) or not len(right):  # a block that no row was dealt to
        return pd.DataFrame({"src": [], "dst": []}).astype("int64")
    node, size = right["node"].to_numpy(), right["size"].to_numpy()
    lengths = right["columns"].map(len).to_numpy()
    column = np.concatenate(right["columns"].to_list())
    order = np.argsort(column, kind="stable")
    column, holder = column[order], np.repeat(np.arange(len(right)), lengths)[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for me, mine, columns, side in zip(left["node"].tolist(), left["size"].tolist(), left["columns"], left["side"]):
        least = _ceil_share(share / (1 + share), mine + size)
        able = (least <= len(columns)) & (least <= lengths) & (node != me)
        if side == 0:
            able &= node > me
        if not able.any():
            continue
        lo, hi = np.searchsorted(column, columns, "left"), np.searchsorted(column, columns, "right")
        overlap = np.bincount(holder[textvec.ragged(lo, hi - lo)], minlength=len(right))
        for j in np.flatnonzero(able & (overlap >= least)):
            a, b = root(me), root(int(node[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((me, int(node[j])))
    return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")


def _filled(rows: Column, cells: Column) -> Column:
    """Blocks that so many rows and cells fill."""
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(cells / BLOCK_CELLS)).cast("int")


def _product(dealt: DataFrame, share: Fraction) -> DataFrame:
    """Spanning forests (src, dst) of each pair of blocks in ``dealt(component, g, h, i, j, side, node, size, columns)``."""
    return dealt.groupBy("component", "g", "h", "i", "j").applyInPandas(lambda pdf: _links(pdf, share), "src long, dst long")


def _hub_links(member: DataFrame, share: Fraction) -> DataFrame | None:
    """Links of the rows of large size classes with one block of their class; None if no class is large."""
    large = member.groupBy("component", "grade").agg(_filled(F.count("*"), F.sum(F.size("columns"))).alias("blocks")).filter(F.col("blocks") > HUB_BLOCKS)
    large = staged(large, "large")
    if not large.head(1):
        return None
    placed = member.join(large, ["component", "grade"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = "if(block = 0, transform(sequence(0, blocks - 1), x -> named_struct('j', x, 'side', if(x = 0, 0, 1))), array(named_struct('j', block, 'side', 2)))"
    dealt = placed.withColumn("to", F.explode(F.expr(to))).select("component", F.col("grade").alias("g"), F.col("grade").alias("h"), F.lit(0).alias("i"), "to.*", "node", "size", "columns")
    return staged(_product(dealt, share), "hubs")


def _block_links(member: DataFrame, parts: DataFrame | None, share: Fraction) -> DataFrame:
    """Links of all pairs of blocks but those inside one part (``parts``: node, component), whose rows are linked already."""
    if parts is None:
        member = member.withColumn("part", F.lit(-1).cast("long"))
    else:
        member = member.join(parts.select("node", F.col("component").alias("part")), "node", "left").withColumn("part", F.coalesce("part", F.lit(-1)).cast("long"))
    # small parts and rows without one share blocks, under the label -1
    of = member.groupBy("component", "grade", "part").agg(F.count("*").alias("rows"), F.sum(F.size("columns")).alias("cells"))
    of = of.withColumn("label", F.when((F.col("rows") >= BLOCK_ROWS) | (F.col("cells") >= BLOCK_CELLS), F.col("part")).otherwise(F.lit(-1)))
    whole = Window.partitionBy("component", "grade")
    spread = of.groupBy("component", "grade", "label").agg(_filled(F.sum("rows"), F.sum("cells")).alias("own"))
    spread = staged(spread.withColumns({"hi": F.sum("own").over(whole.orderBy("label")).cast("int"), "total": F.sum("own").over(whole).cast("int")}), "spread")
    place = of.select("component", "grade", "part", "label").join(spread.select("component", "grade", "label", "own", "hi", "total"), ["component", "grade", "label"])
    for name, step in (("above", 1), ("below", -1)):
        there = spread.withColumn("grade", F.col("grade") - step)
        totals = there.select("component", "grade", F.col("total").alias(f"total_{name}")).distinct()
        ranges = there.filter("label >= 0").select("component", "grade", "label", (F.col("hi") - F.col("own")).alias(f"lo_{name}"), F.col("hi").alias(f"hi_{name}"))
        place = place.join(totals, ["component", "grade"], "left").join(ranges, ["component", "grade", "label"], "left")
    placed = member.join(place, ["component", "grade", "part"]).withColumn("block", F.expr("cast(hi - own + pmod(xxhash64(node), own) as int)"))
    own = "transform(filter(sequence(0, total - 1), x -> label < 0 or x < hi - own or x >= hi), x -> named_struct('g', grade, 'h', grade, 'i', least(block, x), 'j', greatest(block, x), 'side', case when x = block then 0 when block < x then 1 else 2 end))"
    others = "if(total_{0} > 0, filter(sequence(0, total_{0} - 1), x -> lo_{0} is null or x < lo_{0} or x >= hi_{0}), array())"
    above = f"transform({others.format('above')}, x -> named_struct('g', grade, 'h', grade + 1, 'i', block, 'j', x, 'side', 1))"
    below = f"transform({others.format('below')}, x -> named_struct('g', grade - 1, 'h', grade, 'i', x, 'j', block, 'side', 2))"
    dealt = placed.withColumn("to", F.explode(F.expr(f"concat({own}, {above}, {below})"))).select("component", "to.*", "node", "size", "columns")
    return _product(dealt, share)


def links(docs: DataFrame, sets: DataFrame, n: int, share: Fraction) -> tuple[DataFrame, DataFrame]:
    """Links between rows of the matrix whose closure is that of all links (src, dst), and the rows (node, set_a, set_b)."""
    spark = docs.sparkSession
    keys = staged(_candidates(sets), "keys")
    few = keys.count() <= BROADCAST_KEYS
    texts = docs.select("text").join(F.broadcast(keys) if few else keys, F.xxhash64("text") == F.col("text_key"), "left_semi")
    whole = staged(whole_sets(texts, n).dropDuplicates(["set_a", "set_b"]).withColumn("node", F.monotonically_increasing_id()), "rows")
    cells = whole.select("node", F.explode("columns").alias("column"))
    known = cells.groupBy("column").agg(F.count("*").alias("df")).filter("df > 1")
    numer, denom = share.numerator, share.denominator
    rare = cells.join(known, "column").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "column"))).alias("shared"))
    prefix = F.expr(f"size - (size * {numer} + {denom - 1}) div {denom} + 1 - (size - size(shared))")
    rare = whole.select("node", "size").join(rare, "node").withColumn("left", prefix).filter("left > 0")
    rare = staged(rare.select("node", "size", F.expr("transform(slice(shared, 1, cast(left as int)), x -> x.column)").alias("prefix"), F.expr("array_sort(transform(shared, x -> x.column))").alias("columns")), "rare")
    posts = rare.select("node", F.explode("prefix").alias("column"))
    meet = posts.join(posts.groupBy("column").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last"), "column")
    clusters = connected_components(meet.select(F.col("node").alias("src"), F.col("first").alias("dst")))
    # size classes: sizes of one class or of adjacent ones may differ by the factor `share`
    base = float(1 / share)
    grade = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(base)) + 1e-9).cast("long")
    member = staged(rare.join(clusters, "node").select("node", "size", "columns", "component", grade.alias("grade")), "member")
    hubs = _hub_links(member, share)
    found = _block_links(member, connected_components(hubs) if hubs is not None else None, share)
    found = found if hubs is None else found.union(hubs)
    return staged(found, "links"), whole.select("node", "set_a", "set_b")


def labelled(docs: DataFrame, n: int, share: Fraction) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, label (null without shingles), low (the label's smallest doc_id)."""
    sets = staged(shingle_sets(docs, n, share).withColumn("row", F.monotonically_increasing_id()), "sets")
    # copies of one set are aggregated by salt first and get their label by salt, as they may be a third of all rows
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    split = staged(salted.filter("n_shingles > 0").groupBy("set_a", "set_b", "salt").agg(F.min("doc_id").alias("first")), "split")
    group = split.groupBy("set_a", "set_b").agg(F.min("first").alias("first"))
    found, rows = links(docs, sets, n, share)
    component = rows.join(connected_components(found), "node").select("set_a", "set_b", "component")
    lows = group.join(component, ["set_a", "set_b"]).groupBy("component").agg(F.min("first").alias("low"))
    known = component.join(lows, "component")
    # a label is a component's node, or the set itself, which no node number equals as a text
    alone = F.concat_ws(":", "set_a", "set_b")
    group = group.join(known, ["set_a", "set_b"], "left").select("set_a", "set_b", F.coalesce(F.col("component").cast("string"), alone).alias("label"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("low")).alias("low"))
    by_salt = split.select("set_a", "set_b", "salt").join(group, ["set_a", "set_b"])
    return salted.select("doc_id", "text_key", "n_shingles", "set_a", "set_b", "salt").join(by_salt, ["set_a", "set_b", "salt"], "left").drop("set_a", "set_b", "salt")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """Documents linked by Jaccard similarity of their distinct n-word shingles.

    Returns one row per document: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, its own included).  Words are runs of non-blank
    characters, A-Z in lower case; a document of fewer than ``n`` words has all of
    them as one shingle.  Null, empty and blank texts have none and are linked
    with nothing.  A null doc_id takes part, but counts as no smallest one (a
    component of such only has a null id); repeated rows are rows of their own;
    an empty table gives none; other columns are ignored.
    """
    found = labelled(docs, n, Fraction(threshold))
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; all columns stay.

    Rows without words stay.  Null doc_ids come last; of rows with one doc_id the
    lowest text hash stays, of wholly equal ones the first.
    """
    found = labelled(docs, n, Fraction(threshold)).filter("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = found.groupBy("label").agg(F.min(place).alias("best")).select(F.col("best.doc_id").alias("__id"), F.col("best.text_key").alias("__key"))
    row = Window.partitionBy("doc_id", "__key").orderBy(F.lit(0))
    blank = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == ""
    keyed = docs.withColumns({"__key": F.xxhash64("text"), "__blank": blank})
    kept = keyed.filter(~F.col("__blank")).join(best.withColumnRenamed("__key", "__best"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__best")), "left_semi")
    kept = kept.withColumn("__turn", F.row_number().over(row)).filter("__turn = 1").drop("__turn")
    return kept.unionByName(keyed.filter("__blank")).drop("__key", "__blank")
