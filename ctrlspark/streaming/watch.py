"""Structured Streaming forms of the document watch and of the monitor's state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lineage import snapshot_id

#: the state store that keyed state of several variables needs
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENT = "doc_id long, version_ord int, snapshot_id string, markdown_hash string, parent_snapshot_id string, parent_version int, parent_hash string, markdown string"


class VersionWatch(StatefulProcessor):
    """Keeps each document's last content hash and head snapshot; emits versions whose content differs from the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "markdown_hash string, snapshot_id string, version_ord int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("version_ord", kind="stable")
        head = self.head.get() if self.head.exists() else None
        before, out = head, []
        for version, markdown in zip(seen["version_ord"], seen["markdown"]):
            markdown = markdown or ""
            digest = hashlib.sha256(markdown.encode()).hexdigest()
            if head is not None and head[0] == digest:
                continue
            name = snapshot_id(key[0], digest, version)
            parent = head or (None, None, None)
            out.append((key[0], int(version), name, digest, parent[1], parent[2], parent[0], markdown))
            head = (digest, name, int(version))
        if head is not None and head != before:
            self.head.update(head)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])
        yield frame.astype({"parent_version": "Int32", "version_ord": "int32", "doc_id": "int64"})

    def close(self) -> None:
        pass


def version_events(stream: DataFrame) -> DataFrame:
    """New versions of streamed documents(doc_id, version_ord, markdown), each with its parent; rows without an id are left out."""
    rows = stream.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("version_ord").cast("int").alias("version_ord"), "markdown")
    return rows.groupBy("doc_id").transformWithStateInPandas(VersionWatch(), EVENT, "append", "None")


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def watch_documents(stream: DataFrame, store: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame] | None = None):
    """Commit changed versions of streamed documents and publish an alert for each change; returns the running query.

    A version is compared with the one that the state names as its document's head, in
    whatever batch that came: the first sight of a document is committed in silence, the same
    content again does nothing.  ``analyse`` makes alerts of documents(doc_id,
    version_ord, markdown) that hold parents and children (``impact.alerts_between``).

    Below ``store``: ``snapshots`` and ``alerts`` have a folder for each batch, which a
    batch that is run again replaces; ``blobs`` has each text once, by its hash, in folders by
    the hash's first two digits, so that parents are found without reading all of it.
    """
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)

    def commit(batch: DataFrame, number: int) -> None:
        path = f"{store}/events/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        session = batch.sparkSession
        events = session.read.schema(batch.schema).parquet(path)
        if not events.head(1):
            return
        events.drop("markdown", "parent_hash", "parent_version").write.mode("overwrite").parquet(f"{store}/snapshots/batch={number}")
        blobs = events.select("markdown_hash", "markdown", F.substring("markdown_hash", 1, 2).alias("prefix")).dropDuplicates(["markdown_hash"])
        # at most 256 different ones
        wanted = [r.p for r in events.select(F.explode(F.array(F.substring("markdown_hash", 1, 2), F.substring("parent_hash", 1, 2))).alias("p")).filter("p is not null").distinct().collect()]
        held = f"{store}/blobs"
        if _there(session, held):
            kept = session.read.schema(blobs.schema).parquet(held).filter(F.col("prefix").isin(wanted))
            blobs = blobs.join(kept.select("markdown_hash"), "markdown_hash", "left_anti")
        blobs.write.mode("append").partitionBy("prefix").parquet(held)
        changed = events.filter("parent_snapshot_id is not null")
        if analyse is not None and changed.head(1):
            kept = session.read.schema(blobs.schema).parquet(held).filter(F.col("prefix").isin(wanted))
            old = changed.select("doc_id", F.col("parent_version").alias("version_ord"), F.col("parent_hash").alias("markdown_hash")).join(kept.select("markdown_hash", "markdown"), "markdown_hash")
            docs = changed.select("doc_id", "version_ord", "markdown").unionByName(old.select("doc_id", "version_ord", "markdown")).dropDuplicates(["doc_id", "version_ord"])
            analyse(docs).write.mode("overwrite").parquet(f"{store}/alerts/batch={number}")

    return version_events(stream).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _next(status: str, finding: str, prior: tuple | None) -> str:
    was, before = prior or ("", "")
    if status == "aligned":
        return "recovered" if was in ("misaligned", "review_required") else "unchanged"
    if not before or was in ("", "aligned"):
        return "opened"
    return "changed" if before != finding else "repeated"


def state_stream(runs: DataFrame) -> DataFrame:
    """Transitions of streamed runs(monitor_id, run_id, run_ts, status, finding), with state by monitor."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["run_ts", "run_id"])
        prior = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            out.append((key[0], r.run_id, _next(r.status, r.finding, prior)))
            prior = (r.status, r.finding)
        state.update(prior)
        yield pd.DataFrame(out, columns=["monitor_id", "run_id", "transition"])

    return runs.groupBy("monitor_id").applyInPandasWithState(step, "monitor_id long, run_id long, transition string", "status string, finding string", "append", GroupStateTimeout.NoTimeout)


SEVERITIES = ("info", "low", "medium", "high", "critical")


class Outbox(StatefulProcessor):
    """Decides what runs send; what counts as sent advances only when a delivery is acknowledged."""

    def __init__(self, threshold: str, on_recovery: bool):
        self.least, self.on_recovery = SEVERITIES.index(threshold), on_recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")
        self.last = handle.getValueState("last", "finding string, input string")
        self.pending = handle.getMapState("pending", "run_id long", "finding string, input string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "is_outcome", "run_id"])
        out = []
        for r in seen.itertuples():
            if r.is_outcome:
                if self.pending.containsKey((r.run_id,)):
                    if r.delivered:
                        self.last.update(tuple(self.pending.getValue((r.run_id,))))
                    self.pending.removeKey((r.run_id,))
                continue
            prior = self.status.get()[0] if self.status.exists() else ""
            self.status.update((r.status,))
            bad = r.status != "aligned"
            loud = bad and (SEVERITIES.index(r.severity) if r.severity in SEVERITIES else 0) >= self.least
            recovered = not bad and self.on_recovery and prior in ("misaligned", "review_required") and self.last.exists()
            if not (loud or recovered):
                out.append((key[0], r.run_id, "none", "quiet"))
                continue
            again = self.last.exists() and tuple(self.last.get()) == (r.finding, r.input)
            if not again:
                self.pending.updateValue((r.run_id,), (r.finding, r.input))
            out.append((key[0], r.run_id, "recovered" if recovered else "misaligned", "suppressed" if again else "sent"))
        yield pd.DataFrame(out, columns=["monitor_id", "run_id", "event", "decision"]).astype({"monitor_id": "int64", "run_id": "int64"})

    def close(self) -> None:
        pass


def monitor_log(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs and delivery outcomes as rows of one log, batch or stream, for ``notify_stream``."""
    own = runs.select(F.col("monitor_id").cast("long").alias("monitor_id"), F.col("run_id").cast("long").alias("run_id"), F.col("run_ts").alias("ts"), F.lit(False).alias("is_outcome"), "status", "severity", "finding", "input", F.lit(False).alias("delivered"))
    none = [F.lit("").alias(c) for c in ("status", "severity", "finding", "input")]
    return own.unionByName(outcomes.select(F.col("monitor_id").cast("long").alias("monitor_id"), F.col("run_id").cast("long").alias("run_id"), "ts", F.lit(True).alias("is_outcome"), *none, "delivered"))


def notify_stream(log: DataFrame, threshold: str = "high", on_recovery: bool = True) -> DataFrame:
    """``monitor.notify_decision`` over a streamed log: monitor_id, run_id, event, decision of each run."""
    log.sparkSession.conf.set(*STATE_STORE)
    return log.groupBy("monitor_id").transformWithStateInPandas(Outbox(threshold, on_recovery), "monitor_id long, run_id long, event string, decision string", "append", "None")


def as_batch(rows: DataFrame) -> DataFrame:
    """The columns of a run, for comparing stream and batch."""
    return rows.select(F.col("monitor_id").cast("long"), F.col("run_id").cast("long"), "run_ts", "status", "finding")
