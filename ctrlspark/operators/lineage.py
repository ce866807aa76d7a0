"""Versioned documents: snapshots, history, diffs and drift, for all documents at once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def snapshot_id(doc_id: int, markdown_hash: str, version_ord: int) -> str:
    """Name of a snapshot, from document, content and version; ``commit_snapshots`` has it as a column."""
    return hashlib.sha256(f"pol-{doc_id}:{markdown_hash}:v{version_ord}".encode()).hexdigest()[:20]


def _chain():
    return Window.partitionBy("doc_id").orderBy("version_ord")


def commit_snapshots(docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Snapshots of versions: markdown_hash, snapshot_id, parent_snapshot_id.

    Keyed by snapshot_id: those that ``existing`` holds are left out, so committing
    the same content again adds nothing and makes no snapshot its own parent.
    """
    s = docs.select("doc_id", "version_ord", F.concat(F.lit("v"), "version_ord").alias("version_label"), F.sha2("markdown", 256).alias("markdown_hash"))
    s = s.withColumn("snapshot_id", F.substring(F.sha2(F.concat_ws(":", F.concat(F.lit("pol-"), "doc_id"), "markdown_hash", "version_label"), 256), 1, 20))
    s = s.withColumn("parent_snapshot_id", F.lag("snapshot_id").over(_chain()))
    return s if existing is None else s.join(existing.select("snapshot_id"), "snapshot_id", "left_anti")


def commit(docs: DataFrame, held: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """What committing versions adds to a content-addressed store: rows of blobs, snapshots and log.

    ``docs``: doc_id, version_ord, markdown, and base_version where a version branches
    off another one than its predecessor.  ``held``: the tables that the store has
    (``blobs``: markdown_hash, markdown; ``snapshots``: as returned).  Texts and
    snapshots that are held, or come twice, are not added again, so a commit that is
    repeated adds nothing, and no snapshot is its own parent.  A version without a base has the
    version before it as its parent, new or held.
    """
    docs = staged(docs, "docs")  # read several times below
    base = F.col("base_version") if "base_version" in docs.columns else F.lit(None).cast("int")
    new = commit_snapshots(docs).drop("parent_snapshot_id").join(docs.select("doc_id", "version_ord", base.alias("base_version")).distinct(), ["doc_id", "version_ord"]).dropDuplicates(["snapshot_id"])
    blobs = docs.select(F.sha2("markdown", 256).alias("markdown_hash"), "markdown").dropDuplicates(["markdown_hash"])
    every = new.select("doc_id", "version_ord", "snapshot_id")
    if held is not None:
        every = every.unionByName(held["snapshots"].select("doc_id", "version_ord", "snapshot_id")).dropDuplicates(["snapshot_id"])
    before = every.withColumn("before", F.lag("snapshot_id").over(_chain())).select("snapshot_id", "before")
    named = every.select("doc_id", F.col("version_ord").alias("base_version"), F.col("snapshot_id").alias("base"))
    new = new.join(before, "snapshot_id").join(named, ["doc_id", "base_version"], "left").withColumn("parent_snapshot_id", F.coalesce("base", "before"))
    if held is not None:
        new = new.join(held["snapshots"].select("snapshot_id"), "snapshot_id", "left_anti")
        blobs = blobs.join(held["blobs"].select("markdown_hash"), "markdown_hash", "left_anti")
    new = new.select("doc_id", "version_ord", "version_label", "markdown_hash", "snapshot_id", "parent_snapshot_id")
    return {"blobs": blobs, "snapshots": new, "log": new.select("doc_id", "snapshot_id", "version_label", F.lit("commit").alias("event"))}


def head(snapshots: DataFrame) -> DataFrame:
    """The current snapshot of each document."""
    return snapshots.groupBy("doc_id").agg(F.max_by("snapshot_id", "version_ord").alias("snapshot_id"))


def history(snapshots: DataFrame) -> DataFrame:
    """Each document's head and what it comes from, along parents: depth 0 is the head; other branches are left out.

    By doubling: with the ancestors up to some depth and a table of jumps of that
    length, one join gives as many again, so a chain of n snapshots takes log n rounds.
    """
    snapshots = staged(snapshots.select("doc_id", "version_ord", "snapshot_id", "parent_snapshot_id"), "snapshots")
    found = head(snapshots).withColumn("depth", F.lit(0).cast("long"))
    jump = snapshots.select(F.col("snapshot_id").alias("at"), F.col("parent_snapshot_id").alias("to")).filter("to is not null").join(snapshots.select(F.col("snapshot_id").alias("to")), "to", "left_semi").select("at", "to")
    reach, most = 1, snapshots.count()
    while reach < most:
        more = staged(found.join(jump, F.col("snapshot_id") == F.col("at")).select("doc_id", F.col("to").alias("snapshot_id"), (F.col("depth") + reach).alias("depth")), "ancestors")
        if not more.head(1):
            break
        found = found.unionByName(more)
        jump = staged(jump.join(jump.toDF("at2", "to2"), F.col("to") == F.col("at2")).select("at", F.col("to2").alias("to")), "jumps")
        reach *= 2
    return found


def version_pairs(docs: DataFrame) -> DataFrame:
    """Consecutive versions of each document: older, newer."""
    return docs.select("doc_id", F.lag("version_ord").over(_chain()).alias("older"), F.col("version_ord").alias("newer")).filter("older is not null")


def statement_diff(statements: DataFrame, docs: DataFrame) -> DataFrame:
    """Statements added or removed between consecutive versions, by content hash."""
    pairs = version_pairs(docs)
    side = lambda c: statements.withColumnRenamed("version_ord", c).join(pairs.hint("merge"), ["doc_id", c]).select("doc_id", "older", "newer", "content_hash", "statement_id", "stmt_ord", "text", "strength", "statement_kind", "framework_ids")
    on = ["doc_id", "older", "newer", "content_hash"]
    old, new = side("older"), side("newer")
    return old.join(new.select(*on).hint("merge"), on, "left_anti").withColumn("change", F.lit("removed")).unionByName(new.join(old.select(*on).hint("merge"), on, "left_anti").withColumn("change", F.lit("added")))


def lost_citations(statements: DataFrame, docs: DataFrame) -> DataFrame:
    """Control ids that a version cites and the next one no more: doc_id, older, newer, subject."""
    cited = statements.select("doc_id", "version_ord", F.explode("framework_ids").alias("subject")).distinct()
    pairs = version_pairs(docs)
    old = cited.withColumnRenamed("version_ord", "older").join(pairs.hint("merge"), ["doc_id", "older"]).select("doc_id", "older", "newer", "subject")
    return old.join(cited.withColumnRenamed("version_ord", "newer").hint("merge"), ["doc_id", "newer", "subject"], "left_anti").select("doc_id", "older", "newer", "subject")


def drift(statements: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings between consecutive versions: removed and added duties, citations lost."""
    d = statement_diff(statements, docs)
    removed = F.col("change") == "removed"
    severity = F.when(removed & F.col("strength").isin("must", "shall", "prohibited"), "high").when(removed, "medium").otherwise("info")
    found = d.select("doc_id", "older", "newer", F.when(removed, "obligation_removed").otherwise("obligation_added").alias("kind"), F.col("statement_id").alias("subject"), severity.alias("severity"))
    return found.unionByName(lost_citations(statements, docs).select("doc_id", "older", "newer", F.lit("framework_citation_lost").alias("kind"), "subject", F.lit("high").alias("severity")))


def statement_lists(snapshots: DataFrame, statements: DataFrame) -> DataFrame:
    """Snapshots with the ids of their statements in order."""
    ids = statements.groupBy("doc_id", "version_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("stmt_ord", "statement_id"))), lambda x: x["statement_id"]).alias("statement_ids"))
    return snapshots.join(ids.hint("merge"), ["doc_id", "version_ord"], "left")


def load_statements(snapshots: DataFrame, store: DataFrame) -> DataFrame:
    """Statements of snapshots(snapshot_id, statement_ids) in the order of their ids, from a content-addressed ``store``(statement_id, text)."""
    wanted = snapshots.select("snapshot_id", F.posexplode("statement_ids").alias("place", "statement_id"))
    return wanted.join(store.hint("merge"), "statement_id").select("snapshot_id", "place", "statement_id", "text")


def read_markdown(snapshots: DataFrame, blobs: DataFrame) -> DataFrame:
    """Text of snapshots by hash, from ``blobs``(markdown_hash, markdown)."""
    return snapshots.join(blobs.hint("merge"), "markdown_hash").select("snapshot_id", "markdown")
