"""Impact of wording changes between versions of policies."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import change_rules as c
from ..functions import rules
from ..functions.dialect import SPARK
from ..sources.tables import staged
from . import crosswalk, extract, lineage, registry

PAIR = ["doc_id", "older", "newer"]
#: a pair of statements below this score is no rewording
THRESHOLD = 0.5


def describe(pairs: DataFrame, *columns: str) -> DataFrame:
    """Adds {column}_strength and {column}_polarity of each text column."""
    for name in columns:
        pairs = pairs.withColumn("__verbs", F.expr(rules.verbs(SPARK, name))).withColumn("__ids", F.expr(rules.control_ids(SPARK, name)))
        pairs = pairs.withColumn(f"{name}_strength", F.expr(rules.classify(SPARK, name, "__verbs", "__ids")["strength"])).withColumn(f"{name}_polarity", F.expr(rules.polarity(SPARK, name, "__verbs"))).drop("__verbs", "__ids")
    return pairs


#: distinct pairs of texts that a join may broadcast; more of them are joined by shuffle
FEW = 20_000
_TEXTS = ["before", "after", "before_heading", "after_heading"]


def change_kinds(pairs: DataFrame, few: int = FEW) -> DataFrame:
    """Kind, deadline change, severity and note of each (before, after) pair; before_heading and after_heading are '' if not there.

    All of it follows from the texts, so each distinct pair of texts goes through the rules once.
    """
    p = pairs.withColumns({h: F.coalesce(h, F.lit("")) if h in pairs.columns else F.lit("") for h in _TEXTS[2:]})
    judged = staged(_judged(p.select(*_TEXTS).distinct()), "texts")
    j = judged.select(F.struct(*_TEXTS).alias("__texts"), *(x for x in judged.columns if x not in _TEXTS))
    j = F.broadcast(j) if judged.limit(few + 1).count() <= few else j.hint("merge")
    return p.join(j, F.struct(*(p[x] for x in _TEXTS)).eqNullSafe(F.col("__texts"))).drop("__texts")


def _judged(p: DataFrame) -> DataFrame:
    # the few distinct pairs are dealt out, as each is much work
    p = describe(p.repartition(p.sparkSession.sparkContext.defaultParallelism), "before", "after")
    p = p.withColumns({name: F.expr(x) for name, x in c.change_features(SPARK, "before", "after").items()})
    p = p.withColumn("change_kind", F.expr(c.change_kind(SPARK, "before", "after")))
    return p.withColumns({"risk": F.expr(c.change_risk("change_kind", "before_strength", "sla")), "note": F.expr(c.change_note(SPARK, "change_kind", "before", "after"))})


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


#: characters that are counted one by one; all others count as one more
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _counts(text: Column) -> Column:
    """How often each of COUNTED and anything else stands in a text."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))) for x in COUNTED]
    return F.array(*each, F.length(text) - sum(each[1:], each[0]))


def match_score(diff: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of removed against added statements of a version pair: text, words, domains, citations, heading, action.

    Pairs that can't reach the threshold are left out before their texts are
    compared: the ratio of two texts is at most twice the characters they share,
    whatever their order, over their lengths, and all other terms are known.
    """
    low = F.lower("text")
    words = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), 1), lambda w: ~w.isin(*c.STOP_WORDS) & (F.length(w) > 1)))
    about = {"low": low, "counts": _counts(low), "w": words, "act": F.expr(c.main_action(SPARK, "text"))}
    one = diff.withColumns(about)
    side = lambda kind, mark: one.filter(F.col("change") == kind).select(*PAIR, *(F.col(x).alias(f"{mark}_{x}") for x in ("statement_id", "stmt_ord", "text", "strength", "keywords", "framework_ids", "heading_path", *about)))
    p = side("removed", "a").join(side("added", "b").hint("merge"), PAIR)
    union = F.size(F.array_union("a_w", "b_w"))
    jaccard = F.when(union > 0, F.size(F.array_intersect("a_w", "b_w")) / union).otherwise(0.0)
    opposite = F.expr(" or ".join(f"(a_act = '{x}' and b_act = '{y}') or (a_act = '{y}' and b_act = '{x}')" for x, y in c.OPPOSITES))
    action = F.when((F.col("a_act") == "") | (F.col("b_act") == ""), 0.0).when(F.col("a_act") == F.col("b_act"), 0.05).when(opposite, 0.02).otherwise(-0.22)
    same_heading = F.coalesce(F.try_element_at("a_heading_path", F.lit(-1)) == F.try_element_at("b_heading_path", F.lit(-1)), F.lit(False))
    rest = [0.2 * jaccard, F.when(F.arrays_overlap("a_keywords", "b_keywords"), 0.08).otherwise(0.0), F.when(F.arrays_overlap("a_framework_ids", "b_framework_ids"), 0.05).otherwise(0.0), F.when(same_heading, 0.02).otherwise(0.0), action]
    score = lambda ratio: F.round(F.greatest(F.lit(0.0), F.least(sum(rest, 0.65 * ratio), F.lit(1.0))), 4)
    shared = F.aggregate(F.zip_with("a_counts", "b_counts", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    most = F.coalesce(F.try_divide(2.0 * shared, F.length("a_low") + F.length("b_low")), F.lit(1.0))
    near = p.withColumn("bound", score(most)).filter(F.col("bound") >= threshold)
    near = near.withColumn("ratio", _ratio("a_low", "b_low")).withColumn("score", score(F.col("ratio")))
    return near.drop("ratio", *(f"{m}_{x}" for m in "ab" for x in about))


def greedy_pairs(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One-to-one pairs, best score first; ties by old and then new ordinal.

    In rounds: a pair that is the best one left of both its statements is taken,
    and all others of the two go; this gives the pairs of the one-by-one choice.
    Rounds are few, as each takes the best pair of every version pair at least, and
    as a rule most of them; what is left is written to the shared folder between rounds.
    """
    columns = [*PAIR, "a_statement_id", "a_stmt_ord", "b_statement_id", "b_stmt_ord", "a_text", "b_text", "a_heading_path", "b_heading_path", "score"]
    per = lambda mark: Window.partitionBy(*PAIR, f"{mark}_statement_id")
    best = lambda mark: F.row_number().over(per(mark).orderBy(F.desc("score"), "a_stmt_ord", "b_stmt_ord"))
    left, chosen = scored.filter(F.col("score") >= threshold).select(*columns), []
    while True:
        ranked = left.repartition(*PAIR).withColumns({"__a": best("a"), "__b": best("b")}).withColumn("__taken", ((F.col("__a") == 1) & (F.col("__b") == 1)).cast("int"))
        gone = F.greatest(F.max("__taken").over(per("a")), F.max("__taken").over(per("b")))
        table = staged(ranked.withColumn("__gone", gone).filter("__taken = 1 or __gone = 0").select(*columns, "__taken"), "pairs")
        chosen.append(table.filter("__taken = 1").select(*columns))
        left = table.filter("__taken = 0").select(*columns)
        if not left.head(1):
            return reduce(DataFrame.unionByName, chosen)


CHANGE = [*PAIR, "before_id", "after_id", "before", "after", "before_strength", "change_kind", "sla", "risk", "note"]


def verbiage_changes(diff: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Reworded, removed and added statements between versions: change_kind, texts, ids, sla, risk, note."""
    pairs = greedy_pairs(match_score(diff, threshold), threshold)
    texts = {"before_id": "a_statement_id", "after_id": "b_statement_id", "before": "a_text", "after": "b_text"}
    heading = lambda m: F.array_join(F.coalesce(f"{m}_heading_path", F.array().cast("array<string>")), " ")
    reworded = change_kinds(pairs.select(*PAIR, *(F.col(x).alias(n) for n, x in texts.items()), heading("a").alias("before_heading"), heading("b").alias("after_heading")))
    alone = lambda kind, mark: diff.filter(F.col("change") == kind).join(pairs.select(*PAIR, F.col(f"{mark}_statement_id").alias("statement_id")).hint("merge"), [*PAIR, "statement_id"], "left_anti")
    none = F.lit("")
    note = lambda kind: F.lit(c.NOTES[kind])
    gone = alone("removed", "a").select(*PAIR, F.col("statement_id").alias("before_id"), none.alias("after_id"), F.col("text").alias("before"), none.alias("after"), F.col("strength").alias("before_strength"), F.lit("obligation_removed").alias("change_kind"), none.alias("sla"), note("obligation_removed").alias("note"))
    new = alone("added", "b").select(*PAIR, none.alias("before_id"), F.col("statement_id").alias("after_id"), none.alias("before"), F.col("text").alias("after"), none.alias("before_strength"), F.lit("obligation_added").alias("change_kind"), none.alias("sla"), note("obligation_added").alias("note"))
    every = reworded.select(*gone.columns).unionByName(gone).unionByName(new)
    return every.withColumn("risk", F.expr(c.change_risk("change_kind", "before_strength", "sla"))).select(*CHANGE)


#: kinds of change that reach frameworks
RISKY = ("obligation_removed", "obligation_softened", "scope_reduced", "prohibition_removed", "obligation_reversed", "sla_changed", "retention_weakened", "threshold_weakened", "obligation_rewritten", "obligation_added")


def touched(statements: DataFrame, changes: DataFrame) -> DataFrame:
    """The statements whose hits ``framework_impacts`` reads: the old (else new) one of each change that reaches frameworks."""
    ids = changes.filter(F.col("change_kind").isin(*RISKY)).select("doc_id", _touches().alias("statement_id")).distinct()
    return statements.join(ids.hint("merge"), ["doc_id", "statement_id"], "left_semi")


def _touches() -> Column:
    return F.when(F.col("before_id") != "", F.col("before_id")).otherwise(F.col("after_id"))


def framework_impacts(changes: DataFrame, hits: DataFrame, lost: DataFrame | None = None, most: int = 3) -> DataFrame:
    """Frameworks that changes touch: risk (the highest), controls, changes, reasons.

    A change counts by the hits of its old (else new) statement; one kind is worth no
    mention and some only harden.  ``lost``: citations of the older version that the newer
    one has no more (PAIR, subject, framework), each a high risk.  Reasons are the ``most``
    gravest notes, equal ones once.
    """
    risky = changes.filter(F.col("change_kind").isin(*RISKY)).withColumns({"rank": F.expr(c.severity_rank("risk")), "statement_id": _touches()})
    met = risky.join(hits.select("doc_id", "statement_id", "framework", "control_id").distinct().hint("merge"), ["doc_id", "statement_id"])
    met = met.select(*PAIR, "framework", "control_id", "rank", "note", "statement_id")
    if lost is not None:
        said = F.concat(F.lit("Citation "), F.col("subject"), F.lit(" is gone from the document."))
        met = met.unionByName(lost.select(*PAIR, "framework", F.col("subject").alias("control_id"), F.lit(3).alias("rank"), said.alias("note"), F.lit(None).cast("string").alias("statement_id")))
    reasons = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("rank")).alias("r"), "note"))), 1, most)
    out = met.groupBy(*PAIR, "framework").agg(F.max("rank").alias("rank"), F.array_join(F.sort_array(F.collect_set("control_id")), ",").alias("controls"), F.count_distinct("statement_id").alias("changes"), reasons.alias("reasons"))
    return out.select(*PAIR, "framework", "controls", "changes", F.array_join(F.transform("reasons", lambda x: x["note"]), "; ").alias("reasons"), F.expr(c.severity_name("rank")).alias("risk"))


@dataclass
class AtRisk:
    """Assessments at risk of version pairs, without a row for each pair and assessment.

    Assessments for all documents that use the same frameworks are at the same risk of a pair:
    ``by_class`` has a row for each pair and such class (PAIR, cls, frameworks, rank), ``classes`` the
    assessments of each (cls, ids in order).  Others are rows of ``named`` (PAIR, assessment_id, frameworks, risk).
    """

    named: DataFrame
    by_class: DataFrame | None = None
    classes: DataFrame | None = None

    def ranks(self) -> DataFrame:
        """PAIR, rank: the risks of each pair."""
        rows = self.named.select(*PAIR, F.expr(c.severity_rank("risk")).alias("rank"))
        return rows if self.by_class is None else rows.unionByName(self.by_class.select(*PAIR, "rank"))

    def rows(self) -> DataFrame:
        """A row for each pair and assessment.  Classes meet their assessments last, in place: the product is never shuffled."""
        named = self.named.select(*PAIR, "assessment_id", "frameworks", "risk")
        if self.by_class is None:
            return named
        every = self.by_class.join(F.broadcast(self.classes.select("cls", F.explode("ids").alias("assessment_id"))), "cls")
        return every.select(*PAIR, "assessment_id", "frameworks", F.expr(c.severity_name("rank")).alias("risk")).unionByName(named)

    def lists(self) -> tuple[DataFrame, DataFrame | None]:
        """(PAIR, own, combo) and (combo, ids): assessments of each pair in order, those of its classes by the classes' combination."""
        own = self.named.groupBy(*PAIR).agg(_listed("assessment_id").alias("own"))
        if self.by_class is None:
            return own.withColumn("combo", F.lit(None).cast("string")), None
        combined = self.by_class.groupBy(*PAIR).agg(F.array_sort(F.collect_set("cls")).alias("parts"))
        combined = combined.withColumn("combo", F.to_json("parts"))
        ids = combined.select("combo", "parts").distinct().select("combo", F.explode("parts").alias("cls")).join(self.classes, "cls")
        ids = ids.groupBy("combo").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
        return own.join(combined.drop("parts").hint("merge"), PAIR, "full_outer"), ids

    def duties(self, duties: DataFrame) -> DataFrame:
        """PAIR and what its assessments must keep up to date (class_id, keep), each once a class."""
        held = self.named.select(*PAIR, "assessment_id").join(duties, "assessment_id").select(*PAIR, "class_id", "keep")
        if self.by_class is None:
            return held
        of = self.classes.select("cls", F.explode("ids").alias("assessment_id")).join(duties, "assessment_id").select("cls", "class_id", "keep").distinct()
        return held.unionByName(self.by_class.select(*PAIR, "cls").join(F.broadcast(of), "cls").select(*PAIR, "class_id", "keep"))


def _at_risk(table: DataFrame | AtRisk | None) -> AtRisk | None:
    return AtRisk(table) if isinstance(table, DataFrame) else table


def severity_rollup(changes: DataFrame, impacts: DataFrame | None = None, at_risk: DataFrame | AtRisk | None = None) -> DataFrame:
    """Highest risk of a version pair's changes, framework impacts and assessments; added statements don't count of themselves."""
    rank = F.expr(c.severity_rank("risk"))
    rows = changes.select(*PAIR, F.when(F.col("change_kind") != "obligation_added", rank).otherwise(0).alias("rank"), F.lit(1).alias("n"))
    for more in (None if impacts is None else impacts.select(*PAIR, rank.alias("rank")), None if at_risk is None else _at_risk(at_risk).ranks()):
        if more is not None:
            rows = rows.unionByName(more.withColumn("n", F.lit(0)))
    worst = rows.groupBy(*PAIR).agg(F.max("rank").alias("rank"), F.sum("n").alias("changes"))
    return worst.select(*PAIR, "changes", F.expr(c.severity_name("rank")).alias("severity"))


#: kinds after which a version isn't to be published before a review
BLOCKING = ("obligation_softened", "obligation_removed", "scope_reduced", "prohibition_removed", "obligation_reversed")
ACTIONS = ("Review the changed wording with the owner of the control.", "Bring narratives and evidence links up to date before the next assessment.", "Do not publish this version before its effect on audits is confirmed.")


def _listed(column: str, most: int | None = None) -> Column:
    """Distinct values in order, as an array."""
    every = F.array_sort(F.collect_set(column))
    return F.slice(every, 1, most) if most else every


#: ids of assessments in all combinations of classes that a join may broadcast; more meet the pairs in a merge join
MANY = 1_000_000


def impact_alerts(changes: DataFrame, impacts: DataFrame | None = None, at_risk: DataFrame | AtRisk | None = None, duties: DataFrame | None = None) -> DataFrame:
    """One alert for each version pair: severity, alert_id, changes, summary, actions (an array) and class_id, the strictest one concerned.

    ``impacts`` as of ``framework_impacts``, ``at_risk`` as of ``assessments_at_risk`` or ``risk_classes``;
    ``duties`` (assessment_id, class_id, documents, cadence) adds what a certified
    assessment must keep up to date.  Lists of assessments are joined last, and never shuffled.
    """
    at_risk = _at_risk(at_risk)
    s = severity_rollup(changes, impacts, at_risk)
    what = changes.groupBy(*PAIR).agg(F.count(F.when(F.col("change_kind") != "obligation_added", 1)).alias("risked"), F.max(F.col("change_kind").isin(*BLOCKING)).alias("blocking"))
    s = s.join(what.hint("merge"), PAIR, "left")
    none = F.array().cast("array<string>")
    s = s.withColumn("frameworks", none) if impacts is None else s.join(impacts.groupBy(*PAIR).agg(_listed("framework").alias("frameworks")).hint("merge"), PAIR, "left").withColumn("frameworks", F.coalesce("frameworks", none))
    if at_risk is not None and duties is not None:
        keep = F.concat(F.lit("Keep the documents of class "), F.upper("class_id"), F.lit(" up to date: "), F.col("documents"), F.when(F.col("cadence") != "", F.concat(F.lit("; package every "), F.col("cadence"))).otherwise(""), F.lit("."))
        held = at_risk.duties(duties.select("assessment_id", "class_id", keep.alias("keep")))
        s = s.join(held.groupBy(*PAIR).agg(F.max("class_id").alias("class_id"), _listed("keep").alias("duties")).hint("merge"), PAIR, "left")
    else:
        s = s.withColumns({"class_id": F.lit(None).cast("string"), "duties": none})
    s = s.withColumns({"ids": none, "own": none})
    if at_risk is not None:
        own, ids = at_risk.lists()
        s = s.drop("ids", "own").join(own.hint("merge"), PAIR, "left").withColumn("own", F.coalesce("own", none))
        if ids is None:
            s = s.withColumn("ids", none)
        else:
            ids = staged(ids, "combinations")
            total = ids.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first().n
            s = s.join(F.broadcast(ids) if total <= MANY else ids.hint("merge"), "combo", "left").withColumn("ids", F.coalesce("ids", none))
    s = s.withColumn("assessments", F.when(F.size("own") == 0, F.col("ids")).otherwise(F.array_sort(F.array_union("own", "ids"))))
    named = lambda column, most, other: F.when(F.size(column) > 0, F.array_join(F.slice(column, 1, most), ", ")).otherwise(other)
    summary = F.concat(F.lit("["), F.upper("severity"), F.lit("] pol-"), "doc_id", F.lit(": "), F.coalesce("risked", F.lit(0)), F.lit(" duties changed; frameworks: "), named("frameworks", 4, "none"), F.lit("; assessments: "), named("assessments", 3, "none"))
    actions = F.filter(F.concat(
        F.array(F.lit(ACTIONS[0]), F.lit(ACTIONS[1]), F.when(F.col("blocking"), ACTIONS[2]), F.when(F.size("frameworks") > 0, F.concat(F.lit("Check coverage again: "), F.array_join("frameworks", ", "))), F.when(F.size("assessments") > 0, F.concat(F.lit("Tell the owners of: "), F.array_join("assessments", ", ")))),
        F.coalesce("duties", none)), lambda x: x.isNotNull())
    alert = F.substring(F.sha2(F.concat_ws(":", F.concat(F.lit("pol-"), "doc_id"), "older", "newer", "severity"), 256), 1, 16)
    return s.select(*PAIR, "changes", "severity", alert.alias("alert_id"), summary.alias("summary"), actions.alias("actions"), F.coalesce("class_id", F.lit("")).alias("class_id"))


def risk_classes(impacts: DataFrame, assessments: DataFrame) -> AtRisk:
    """``assessments_at_risk`` by class: assessments that name no documents and use the same frameworks are judged once a version pair.

    A pair meets each class, not each assessment.  Assessments that name documents (in any of their rows) meet these by key.
    """
    active = assessments.filter("status = 'active'").select("assessment_id", F.explode(F.array_distinct("frameworks")).alias("framework"), "doc_ids")
    hit = F.max((F.col("framework") == "FedRAMP KSI").cast("int")).over(Window.partitionBy(*PAIR)) == 1
    pair = lambda name, risk: F.struct(F.lit(name).alias("framework"), risk.alias("risk"))
    reach = F.when((F.col("framework") == "NIST 800-53") & ~F.col("__hit"), F.array(pair("NIST 800-53", F.col("risk")), pair("FedRAMP KSI", F.col("risk")), pair("FedRAMP", F.col("risk"))))
    reach = reach.when(F.col("framework") == "NIST 800-53", F.array(pair("NIST 800-53", F.col("risk")), pair("FedRAMP", F.lit("medium")))).otherwise(F.array(F.struct("framework", "risk")))
    wide = impacts.select(*PAIR, "framework", "risk").withColumn("__hit", hit).select(*PAIR, F.explode(reach).alias("r")).select(*PAIR, "r.framework", "r.risk")
    everywhere = F.coalesce(F.size("doc_ids") == 0, F.lit(False))
    judged = active.groupBy("assessment_id").agg(F.min(everywhere).alias("everywhere"), F.array_sort(F.collect_set("framework")).alias("uses"))
    # an assessment that comes with and without documents stays with those that name some
    classes = judged.filter("everywhere").groupBy(F.to_json("uses").alias("cls"), "uses").agg(F.array_sort(F.collect_list("assessment_id")).alias("ids"))
    met = registry.with_assessments(wide, active.join(judged.filter("not everywhere").select("assessment_id").hint("merge"), "assessment_id", "left_semi"))
    worst = lambda t, *by: t.groupBy(*PAIR, *by).agg(F.max(F.expr(c.severity_rank("risk"))).alias("rank"), F.array_join(F.sort_array(F.collect_set("framework")), ",").alias("frameworks"))
    named = worst(met, "assessment_id").select(*PAIR, "assessment_id", "frameworks", F.expr(c.severity_name("rank")).alias("risk"))
    by_class = worst(wide.join(F.broadcast(classes.select("cls", F.explode("uses").alias("framework"))), "framework"), "cls")
    return AtRisk(named, by_class, classes.select("cls", "ids"))


def assessments_at_risk(impacts: DataFrame, assessments: DataFrame) -> DataFrame:
    """Active assessments that share a framework with an impact: risk (the highest), frameworks; an empty doc_ids means all documents.

    An 800-53 impact also reaches assessments against the two indicator frameworks, at
    its own risk; if the indicators are hit themselves, theirs stays and the other counts as medium.
    """
    return risk_classes(impacts, assessments).rows()


def alerts_between(docs: DataFrame, catalogs: dict[str, DataFrame], assessments: DataFrame, duties: DataFrame | None = None) -> DataFrame:
    """Alerts for each pair of following versions in ``docs(doc_id, version_ord, markdown)``: from text to alert.

    ``catalogs``: scf, scf_crosswalk, seed, ksi and ksi_words, as of ``crosswalk.map_statements``.
    """
    statements = staged(extract.extract_statements(docs), "statements")
    extra = statements.select("doc_id", "statement_id", "keywords", "heading_path").dropDuplicates(["doc_id", "statement_id"])
    changes = staged(verbiage_changes(lineage.statement_diff(statements, docs).join(extra.hint("merge"), ["doc_id", "statement_id"])), "changes")
    hits = crosswalk.map_statements(staged(touched(statements, changes), "touched"), *(catalogs[n] for n in ("scf", "scf_crosswalk", "seed", "ksi", "ksi_words")))
    lost = lineage.lost_citations(statements, docs).withColumn("framework", F.expr(rules.framework(SPARK, "subject")))
    impacts = staged(framework_impacts(changes, hits, lost), "impacts")
    return impact_alerts(changes, impacts, risk_classes(impacts, assessments), duties)
