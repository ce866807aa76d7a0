"""Classifier evaluation over tables of labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crosswalk, extract, iac, impact, lineage


def exact_metric(cases: DataFrame) -> DataFrame:
    """Share of cases of each suite whose expected and actual value agree: suite, cases, accuracy."""
    return cases.groupBy("suite").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("expected").eqNullSafe(F.col("actual")).cast("double")), 6).alias("accuracy"))


def label_metric(cases: DataFrame) -> DataFrame:
    """Precision, recall and F1 over sets of labels, summed over the cases of a suite; 0 of 0 counts as 1."""
    both = F.size(F.array_intersect("expected", "actual"))
    n = cases.groupBy("suite").agg(F.sum(both).alias("tp"), F.sum(F.size(F.array_distinct("actual")) - both).alias("fp"), F.sum(F.size(F.array_distinct("expected")) - both).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(1.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("suite", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(1.0)), 6).alias("f1"))


def quality_gate(cases: DataFrame, labels: DataFrame | None = None, least: float = 0.95) -> DataFrame:
    """Whether each suite may be relied on: suite, cases, failed_cases, accuracy, passed.

    ``cases`` as of ``eval_cases``; ``labels`` as of ``label_metric``.  A suite passes if its
    accuracy and label scores reach the minimum and no reviewed case failed.
    """
    m = cases.groupBy("suite").agg(F.count("*").alias("cases"), F.count(F.when(~F.col("passed"), 1)).alias("failed_cases"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("accuracy"))
    good = (F.col("accuracy") >= least) & (F.col("failed_cases") == 0)
    if labels is not None:
        m = m.join(labels.select("suite", F.least("precision", "recall", "f1").alias("score")), "suite", "left")
        good = good & F.coalesce(F.col("score") >= least, F.lit(True))
    return m.select("suite", "cases", "failed_cases", "accuracy", good.alias("passed"))


def eval_cases(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Cases of labelled suites against what the rules say: suite, case_id, failed (keys whose stated value differs), passed.

    ``expected``: suite, case_id, values (a map of the stated keys); ``actual``:
    case_id, values.  Keys that a case does not state are not compared; a case
    without an actual row fails on all its keys.
    """
    both = expected.select("suite", "case_id", F.col("values").alias("want")).join(actual.select("case_id", F.col("values").alias("got")), "case_id", "left")
    failed = F.array_sort(F.filter(F.map_keys("want"), lambda k: ~F.try_element_at("want", k).eqNullSafe(F.try_element_at("got", k))))
    return both.withColumn("failed", failed).select("suite", "case_id", F.array_join("failed", ",").alias("failed"), (F.size("failed") == 0).alias("passed"))


_NO_LABELS = "cast(array() as array<string>)"


def _stated(values: dict[str, Column]) -> Column:
    """Values as a map of texts; lists sorted and comma-joined."""
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _list(column: str) -> Column:
    return F.array_join(F.array_sort(F.coalesce(column, F.expr(_NO_LABELS))), ",")


def policy_suite(cases: DataFrame) -> DataFrame:
    """What extraction says of cases(case_id, text): case_id, values, domains; of the first statement, or extract = false."""
    s = extract.extract_statements(cases.select(F.col("case_id").alias("doc_id"), F.lit(1).alias("version_ord"), F.col("text").alias("markdown"))).filter("stmt_ord = 1")
    values = _stated({"extract": F.lit("true"), "kind": F.col("statement_kind"), "strength": F.col("strength"), "action_polarity": F.col("action_polarity"), "domains": _list("keywords"), "status": F.col("status")})
    found = s.select(F.col("doc_id").alias("case_id"), values.alias("values"), F.col("keywords").alias("domains"))
    return cases.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("values", F.create_map(F.lit("extract"), F.lit("false"))).alias("values"), F.coalesce("domains", F.expr(_NO_LABELS)).alias("domains"))


def iac_suite(cases: DataFrame) -> DataFrame:
    """What the classifier says of cases(case_id, resource_type, block, annotations, tags): case_id, values, domains."""
    r = iac.iac_classify(cases)
    values = _stated({"security_sensitive": F.col("security_sensitive").cast("string"), "domains": _list("domains"), "control_ids": _list("control_ids"), "status": F.col("status"), "posture": F.col("posture")})
    return r.select("case_id", values.alias("values"), "domains")


def change_suite(cases: DataFrame) -> DataFrame:
    """Kinds of all changes between the texts of cases(case_id, before, after): case_id, values (kinds, sorted)."""
    docs = cases.select(F.col("case_id").alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(v).alias("version_ord"), F.col(c).alias("markdown")) for v, c in ((1, "before"), (2, "after"))))).alias("v")).select("doc_id", "v.*")
    s = extract.extract_statements(docs)
    extra = s.select("doc_id", "statement_id", "keywords", "heading_path").dropDuplicates(["doc_id", "statement_id"])
    changes = impact.verbiage_changes(lineage.statement_diff(s, docs).join(extra, ["doc_id", "statement_id"]))
    kinds = changes.groupBy(F.col("doc_id").alias("case_id")).agg(F.array_join(F.array_sort(F.collect_list("change_kind")), ",").alias("kinds"))
    return cases.select("case_id").join(kinds, "case_id", "left").select("case_id", _stated({"kinds": F.coalesce("kinds", F.lit(""))}).alias("values"))


def alignment_suite(cases: DataFrame) -> DataFrame:
    """Domains that both classifiers give to cases(case_id, text, resource_type, block, annotations, tags): case_id, values."""
    said, coded = policy_suite(cases).select("case_id", _list("domains").alias("p")), iac_suite(cases).select("case_id", _list("domains").alias("q"))
    return said.join(coded, "case_id").select("case_id", _stated({"policy_domains": F.col("p"), "iac_domains": F.col("q"), "aligned": (F.col("p") == F.col("q")).cast("string")}).alias("values"))


def scf_suite(cases: DataFrame, scf: DataFrame, scf_crosswalk: DataFrame) -> DataFrame:
    """Backbone controls of cases(case_id, domains, control_ids, source_confidence), and whether all hits stay below the source's confidence."""
    s = cases.select(F.col("case_id").alias("doc_id"), F.lit(1).alias("version_ord"), F.col("case_id").cast("string").alias("statement_id"), F.lit(1).cast("long").alias("stmt_ord"), F.col("domains").alias("keywords"), F.col("control_ids").alias("framework_ids"), F.col("source_confidence").alias("confidence"))
    hits = crosswalk.scf_hits(s, scf, scf_crosswalk).join(cases.select(F.col("case_id").alias("doc_id"), "source_confidence"), "doc_id")
    own = hits.groupBy(F.col("doc_id").alias("case_id")).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("framework") == "SCF", F.col("control_id")))), ",").alias("ids"), F.min(F.col("confidence") <= F.col("source_confidence")).alias("capped"))
    return cases.select("case_id").join(own, "case_id", "left").select("case_id", _stated({"scf_control_ids": F.coalesce("ids", F.lit("")), "confidence_capped": F.coalesce("capped", F.lit(True)).cast("string")}).alias("values"))
