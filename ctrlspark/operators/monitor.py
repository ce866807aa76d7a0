"""Monitor runs: transitions between findings, how often they came, and which are worth a notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.change_rules import severity_name, severity_rank
from .reconcile import Gaps, dealt


def _order():
    return Window.partitionBy("monitor_id").orderBy("run_ts", "run_id")


def transition(prior_status, prior_finding, status, finding):
    """How a run's state follows from the one before, as a column."""
    bad = status != "aligned"
    return (
        F.when(~bad & prior_status.isin("misaligned", "review_required"), "recovered")
        .when(bad & (F.coalesce(prior_finding, F.lit("")).eqNullSafe(F.lit("")) | F.coalesce(prior_status, F.lit("")).isin("", "aligned")), "opened")
        .when(bad & (prior_finding != finding), "changed")
        .when(bad, "repeated")
        .otherwise("unchanged")
    )


def state_transition(runs: DataFrame) -> DataFrame:
    """Adds transition: recovered, opened, changed, repeated or unchanged."""
    return runs.withColumn("transition", transition(F.lag("status").over(_order()), F.lag("finding").over(_order()), F.col("status"), F.col("finding")))


def occurrence_tracking(runs: DataFrame) -> DataFrame:
    """Adds occurrence_count, first_seen and last_seen of the finding that a run continues (none for aligned runs), and accepted.

    ``accepted`` is the input of the last aligned run up to this one: what a later
    comparison starts from, as inputs with open findings are not accepted.
    """
    prior = F.lag("finding").over(_order())
    same = (F.col("status") != "aligned") & F.coalesce(prior == F.col("finding"), F.lit(False))
    so_far = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = runs.withColumns({"stretch": F.sum((~same).cast("int")).over(so_far), "accepted": F.last(F.when(F.col("status") == "aligned", F.col("input")), ignorenulls=True).over(so_far)})
    w = Window.partitionBy("monitor_id", "stretch").orderBy("run_ts", "run_id")
    bad = F.col("status") != "aligned"
    return r.withColumns({"occurrence_count": F.when(bad, F.row_number().over(w)).otherwise(0).cast("long"), "first_seen": F.when(bad, F.min("run_ts").over(w)), "last_seen": F.when(bad, F.col("run_ts"))}).drop("stretch")


#: status of a severity's rank and above
LADDER = ((3, "misaligned"), (1, "review_required"), (0, "aligned"))


def status_of(rank: Column) -> Column:
    """Status of the worst severity's rank."""
    out = F.lit(LADDER[-1][1])
    for least, name in reversed(LADDER[:-1]):
        out = F.when(rank >= least, name).otherwise(out)
    return out


def notify_decision(runs: DataFrame, outcomes: DataFrame, threshold: str = "high", on_recovery: bool = True) -> DataFrame:
    """What each run sends, given what was delivered before: monitor_id, run_id, event, decision.

    ``runs``: monitor_id, run_id, run_ts, status, severity, finding, input;
    ``outcomes``: monitor_id, run_id, ts, delivered, one row for each attempt to send.
    A run is worth a notice if it isn't aligned and its severity reaches the
    threshold (event misaligned), or if it is aligned after one that wasn't and a notice
    was delivered before (recovered).  It is suppressed if the last delivered notice had
    its finding and input, else sent.  A send that failed, or is not acknowledged yet,
    changes nothing, so the next run tries again.  Other runs are quiet (event none).
    A monitor's runs are ordered by run_ts and run_id; an outcome counts from its ts on.
    """
    order = Window.partitionBy("monitor_id").orderBy("ts", "is_outcome", "run_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bad = F.col("status") != "aligned"
    reaches = F.expr(severity_rank("severity")) >= F.expr(severity_rank(f"'{threshold}'"))
    was = F.lag("status").over(_order())
    own = runs.select("monitor_id", "run_id", F.col("run_ts").alias("ts"), F.lit(False).alias("is_outcome"), "finding", "input", (bad & reaches).alias("loud"), (~bad & was.isin("misaligned", "review_required")).alias("recovers"), F.lit(False).alias("delivered"))

    def with_outcomes(own: DataFrame) -> DataFrame:
        told = outcomes.select("monitor_id", "run_id", "ts", "delivered").join(own.drop("ts", "is_outcome", "delivered"), ["monitor_id", "run_id"]).withColumn("is_outcome", F.lit(True))
        return own.unionByName(told)

    # a first delivered notice is one of a finding, so whether there was one doesn't depend on recoveries
    known = F.coalesce(F.max((F.col("is_outcome") & F.col("delivered") & F.col("loud")).cast("int")).over(before) == 1, F.lit(False))
    own = _recoveries(with_outcomes(own), known, on_recovery)
    last = F.last(F.when(F.col("is_outcome") & F.col("delivered") & (F.col("loud") | F.col("recovered")), F.struct("finding", "input")), ignorenulls=True).over(before)
    decided = with_outcomes(own).withColumn("last", last).filter("not is_outcome")
    wanted = F.col("loud") | F.col("recovered")
    decision = F.when(~wanted, "quiet").when(F.col("last").eqNullSafe(F.struct("finding", "input")), "suppressed").otherwise("sent")
    return decided.select("monitor_id", "run_id", F.when(F.col("recovered"), "recovered").when(F.col("loud"), "misaligned").otherwise("none").alias("event"), decision.alias("decision"))


def _recoveries(rows: DataFrame, known: Column, on_recovery: bool) -> DataFrame:
    """Runs with ``recovered``: a recovery after a delivered notice."""
    r = rows.withColumn("known", known).filter("not is_outcome")
    return r.withColumn("recovered", F.lit(on_recovery) & F.col("recovers") & F.col("known")).drop("known", "recovers")


def outbox(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What became of each notice that was sent: monitor_id, run_id, event, state (delivered, failed or pending)."""
    of = outcomes.groupBy("monitor_id", "run_id").agg(F.max("delivered").alias("delivered"))
    state = F.when(F.col("delivered"), "delivered").when(~F.col("delivered"), "failed").otherwise("pending")
    return decisions.filter("decision = 'sent'").join(of, ["monitor_id", "run_id"], "left").select("monitor_id", "run_id", "event", state.alias("state"))


def monitor_status(runs: DataFrame) -> DataFrame:
    """Of each monitor: runs, those not aligned, the latest status, the worst severity and the status that it stands for."""
    r = runs.groupBy("monitor_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") != "aligned", 1)).alias("bad"), F.max_by("status", F.struct("run_ts", "run_id")).alias("latest"), F.max(F.expr(severity_rank("severity"))).alias("rank"))
    return r.select("monitor_id", "n", "bad", "latest", F.expr(severity_name("rank")).alias("worst"), status_of(F.col("rank")).alias("standing"))


def finding_fingerprint(gaps: DataFrame | Gaps, target: str) -> DataFrame:
    """One hash of all gaps of a target (of ``Gaps``: the link), whatever their order: target, n, fingerprint."""
    line = lambda x: F.concat_ws("|", x["kind"], x["severity"], F.col(target) if target == "link_id" else x["link_id"], x["iac_ref"])
    said = F.collect_list(F.struct("kind", "severity", "link_id", "iac_ref")).alias("rows")
    printed = lambda t, rows: t.select(target, F.size(rows).cast("long").alias("n"), F.sha2(F.array_join(F.sort_array(F.transform(rows, line)), "\n"), 256).alias("fingerprint"))
    if isinstance(gaps, DataFrame):
        return printed(gaps.groupBy(target).agg(said), F.col("rows"))
    own = gaps.rows.groupBy(target).agg(said)
    if gaps.members is None:
        return printed(own, F.col("rows"))
    # a selection's rows are gathered once and meet its links where these are dealt
    shared = gaps.shared.withColumn("link_id", F.lit("")).groupBy("selection").agg(said).withColumnRenamed("rows", "more")
    members = gaps.members.select("link_id", "selection").join(own, "link_id", "left")
    both = dealt(members, shared).withColumn("rows", F.concat("more", F.coalesce("rows", F.array().cast(own.schema["rows"].dataType))))
    alone = own.join(gaps.members.select("link_id"), "link_id", "left_anti")
    return printed(alone, F.col("rows")).unionByName(printed(both, F.col("rows")))


def input_fingerprint(files: DataFrame) -> DataFrame:
    """One hash of the inputs of each repository and revision: their paths and digests, in order."""
    row = F.concat_ws("|", "path", "digest")
    return files.groupBy("repository", "revision").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "\n"), 256).alias("fingerprint"))


def notification_payload(gaps: DataFrame, target: str, most: int = 30, events: DataFrame | None = None) -> DataFrame:
    """Of each target the ``most`` gravest findings and how many there are: target, n, findings (severity, kind, link, reference).

    ``events`` (target, event) names what the notice is about.
    """
    rank = F.expr(severity_rank("severity"))
    nth = F.row_number().over(Window.partitionBy(target).orderBy(rank.desc(), "kind", "link_id", "iac_ref"))
    r = gaps.withColumn("nth", nth).withColumn("line", F.concat_ws("|", "severity", "kind", "link_id", "iac_ref"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", "line")))), lambda x: x["line"]), "\n")
    out = r.groupBy(target).agg(F.count("*").alias("n"), shown.alias("findings"))
    return out if events is None else events.select(target, "event").join(out, target, "left").select(target, "event", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("findings", F.lit("")).alias("findings"))
