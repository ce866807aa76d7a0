"""Policy against code: links joined to statements and resources, and the gaps between."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iac_rules
from ..functions.change_rules import severity_name, severity_rank
from ..functions.dialect import SPARK
from ..functions.rules import normal_domain
from . import extract
from .registry import with_assessments

IDENTITY = ["repository", "module_path", "address"]
GAP = ["link_id", "doc_id", "kind", "severity", "iac_ref"]


def qualified(r: str = "") -> Column:
    """Address with its module, unless that is the root."""
    return F.when(F.col(f"{r}module_path").isin("", "."), F.col(f"{r}address")).otherwise(F.concat_ws("::", f"{r}module_path", f"{r}address"))


def full_reference(r: str = "") -> Column:
    """Address with module and repository."""
    return F.when(F.coalesce(F.col(f"{r}repository"), F.lit("")) == "", F.col(f"{r}address")).otherwise(F.concat_ws("::", f"{r}repository", qualified(r)))


def link_statement(links: DataFrame, statements: DataFrame) -> DataFrame:
    """The first statement of each link's policy and version whose text holds the anchor, or all keywords if there are any."""
    text = F.lower("text")
    met = F.contains(text, F.lower("anchor")) | ((F.size("keywords_") > 0) & F.forall("keywords_", lambda k: F.contains(text, F.lower(k))))
    both = links.withColumnRenamed("keywords", "keywords_").join(statements.hint("merge"), "doc_id").filter(met)
    first = F.row_number().over(Window.partitionBy("link_id", "version_ord").orderBy("stmt_ord"))
    return both.withColumn("first", first).filter("first = 1").select("link_id", "doc_id", "version_ord", "statement_id", "content_hash")


def _power(text: str) -> Column:
    """The largest power of two that is at most the text's length."""
    return F.pow(F.lit(2), F.floor(F.log2(F.length(text)))).cast("int")


def paths_below(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (resource_type, wanted, path) where the path holds the wanted one, or the wanted one ends with the path.

    Both meet on equal keys, not by type alone: a wanted path on its beginning of
    2, 4, 8 ... characters (as many as it has), a held one on all its parts of the lengths
    that are in use; the whole condition is tested on those that meet.  For the
    second case a wanted path's endings meet whole held paths.
    """
    asked = wanted.filter(F.length("wanted") > 0).withColumn("size", _power("wanted")).withColumn("key", F.expr("substring(wanted, 1, size)"))
    sizes = asked.select("resource_type", "size").distinct()  # a few for each type
    parts = held.join(sizes, "resource_type").filter(F.length("path") >= F.col("size")).withColumn("key", F.explode(F.expr("array_distinct(transform(sequence(1, length(path) - size + 1), i -> substring(path, i, size)))")))
    inside = asked.join(parts, ["resource_type", "size", "key"]).filter(F.contains("path", F.col("wanted"))).select("resource_type", "wanted", "path")
    ends = wanted.filter(F.length("wanted") > 0).withColumn("path", F.explode(F.expr("transform(sequence(1, length(wanted)), i -> substring(wanted, i))")))
    every = wanted.filter("wanted = ''").join(held, "resource_type").select("resource_type", "wanted", "path")  # an empty path is in all
    return inside.unionByName(ends.join(held, ["resource_type", "path"]).select("resource_type", "wanted", "path")).unionByName(every).distinct()


#: links of one selection whose product with its rows is one task's
DEAL = 128


def dealt(links: DataFrame, shared: DataFrame) -> DataFrame:
    """``links`` (link_id, selection, ...) with the rows that ``shared`` has for their selection, dealt out by selection and link.

    A selection may have most links and most rows: its rows go to as many parts as hold ``DEAL`` links each.
    """
    spark = links.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    parts = links.groupBy("selection").agg((1 + F.floor(F.count("*") / DEAL)).cast("int").alias("__parts"))
    one = links.join(parts, "selection").withColumn("__part", F.pmod(F.xxhash64("link_id"), F.col("__parts")).cast("int")).drop("__parts")
    many = shared.join(parts, "selection").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    deal = lambda t: t.repartition(tasks, "selection", "__part")
    return deal(many).join(deal(one).hint("merge"), ["selection", "__part"]).drop("__part")


@dataclass
class Wired:
    """Resources of links; those that links of equal types, paths and repositories share are kept once.

    ``own`` (link_id, repository, revision, module_path, address) are resources that a link declares or names, without those of
    its selection; ``members`` (link_id, selection) the links that share one, ``chosen`` (selection, and a resource) what it holds.
    """

    own: DataFrame
    members: DataFrame | None = None
    chosen: DataFrame | None = None

    def where(self, condition: str) -> Wired:
        if self.members is None:
            return Wired(self.own.filter(condition))
        chosen = self.chosen.filter(condition)
        return Wired(self.own.filter(condition), self.members.join(chosen.select("selection").distinct(), "selection", "left_semi"), chosen)

    def rows(self) -> DataFrame:
        """A row for each link and resource: every pair, as many as there are."""
        return self.own if self.members is None else self.own.unionByName(dealt(self.members, self.chosen).select(*self.own.columns))

    def ids(self) -> DataFrame:
        own = self.own.select("link_id")
        return (own if self.members is None else own.unionByName(self.members.select("link_id"))).distinct()

    def reached(self, *columns: str) -> DataFrame:
        """Resources that any link reaches."""
        own = self.own.select(*columns)
        return (own if self.members is None else own.unionByName(self.chosen.select(*columns))).distinct()


def _as_wired(wired: DataFrame | Wired) -> Wired:
    return Wired(wired) if isinstance(wired, DataFrame) else wired


@dataclass
class Gaps:
    """Gaps of links: ``rows`` (GAP), and those that every link of a selection has: ``shared`` (selection, kind, severity, iac_ref; the severity follows from the kind) of ``members`` (link_id, doc_id, selection)."""

    rows: DataFrame
    shared: DataFrame | None = None
    members: DataFrame | None = None

    def table(self) -> DataFrame:
        return self.rows if self.members is None else self.rows.unionByName(dealt(self.members, self.shared).select(*GAP))

    def more(self, rows: DataFrame) -> Gaps:
        return Gaps(self.rows.unionByName(rows.select(*GAP)), self.shared, self.members)


def _as_gaps(gaps: DataFrame | Gaps) -> Gaps:
    return Gaps(gaps) if isinstance(gaps, DataFrame) else gaps


def wired_resources(links: DataFrame, resources: DataFrame) -> Wired:
    """Resources of each link: those that declare it, those it names by (module-qualified) address, and, of a link
    without addresses, those of its types below its paths; only in its repositories, if it names any.

    Links without addresses select by types, paths and repositories alone, so each such selection is resolved once.
    """
    columns = ["link_id", "repository", "revision", "module_path", "address"]
    resource = [*IDENTITY, "revision"]
    allowed = (F.size("repositories") == 0) | F.array_contains("repositories", F.col("repository"))
    own = links.select("link_id", "repositories", "addresses", "types", "paths")
    r = resources.select(F.col("link_id").alias("declared"), "repository", "revision", "module_path", "address", "resource_type", "relative_path", qualified().alias("qualified"))
    declared = own.join(r.filter("declared <> ''"), F.col("link_id") == F.col("declared"))
    named = own.withColumn("wanted", F.explode("addresses"))
    by_address = [named.join(r, F.col("wanted") == F.col(c)).drop("wanted") for c in ("address", "qualified")]
    single = reduce(DataFrame.unionByName, [declared, *by_address]).filter(allowed).select(*columns)
    r = r.withColumn("path", F.replace("relative_path", F.lit("\\"), F.lit("/")))
    typed = own.withColumn("n", F.count("*").over(Window.partitionBy("link_id"))).filter((F.size("addresses") == 0) & (F.size("types") > 0) & (F.size("paths") > 0))
    typed = typed.withColumn("selection", F.to_json(F.struct("types", "paths", "repositories")))
    wanted = typed.select("selection", "types", "paths", "repositories").distinct().withColumn("resource_type", F.explode("types")).withColumn("wanted", F.explode("paths"))
    met = paths_below(wanted.select("resource_type", "wanted").distinct(), r.select("resource_type", "path").distinct())
    chosen = wanted.join(met, ["resource_type", "wanted"]).join(r, ["resource_type", "path"]).filter(allowed).select("selection", *resource).distinct()
    members = typed.select("link_id", "selection", "n").join(chosen.select("selection").distinct(), "selection", "left_semi")
    # an id that several links have is no member: its rows are put together
    single = single.unionByName(dealt(members.filter("n > 1").drop("n"), chosen).select(*columns)).distinct()
    members = members.filter("n = 1").drop("n")
    beside = single.join(members, "link_id", "left").join(chosen, ["selection", *resource], "left_anti").select(*columns)
    return Wired(beside, members, chosen)


def link_resources(links: DataFrame, resources: DataFrame) -> DataFrame:
    """``wired_resources`` as rows: link_id, repository, revision, module_path, address."""
    return wired_resources(links, resources).rows()


def ambiguous_selector(links: DataFrame, wired: DataFrame) -> DataFrame:
    """Addresses without a module that a link names and that match several of its resources: link_id, revision, address, iac_ref."""
    named = links.select("link_id", F.explode("addresses").alias("address")).filter(~F.contains("address", F.lit("::")))
    met = wired.join(named.distinct(), ["link_id", "address"])
    out = met.groupBy("link_id", "revision", "address").agg(F.count_distinct("repository", "module_path").alias("n"), F.array_join(F.sort_array(F.collect_set(full_reference())), ", ").alias("iac_ref"))
    return out.filter("n > 1").drop("n")


def completeness_gaps(links: DataFrame, matched: DataFrame, wired: DataFrame | Wired, resources: DataFrame) -> DataFrame:
    """Per link the first that applies: ambiguous address, no statement, no code, covered; and resources that declare an unknown link.

    ``matched``, ``wired`` and ``resources`` are of one version and one revision.
    """
    wired = _as_wired(wired)
    # links that select by type name no address, so their shared resources are never ambiguous
    u = ambiguous_selector(links, wired.own).groupBy("link_id").agg(F.min(F.struct("address", "iac_ref")).alias("u"))
    s = matched.select("link_id").distinct().withColumn("has_statement", F.lit(True))
    r = wired.ids().withColumn("has_code", F.lit(True))
    state = links.join(u, "link_id", "left").join(s, "link_id", "left").join(r, "link_id", "left")
    kind = F.when(F.col("u").isNotNull(), "ambiguous_iac_selector").when(F.col("has_statement").isNull(), "missing_policy_statement").when(F.col("has_code").isNull(), "missing_iac_implementation").otherwise("covered")
    own = state.select("link_id", "doc_id", kind.alias("kind"), F.coalesce("u.iac_ref", F.lit("")).alias("iac_ref"))
    known = links.select("link_id")
    orphans = resources.filter("link_id <> ''").join(known, "link_id", "left_anti").select(F.lit("").alias("link_id"), F.lit(None).cast("long").alias("doc_id"), F.lit("orphan_iac_annotation").alias("kind"), full_reference().alias("iac_ref"))
    severity = F.when(F.col("kind") == "covered", "info").when(F.col("kind") == "orphan_iac_annotation", "medium").when(F.col("kind") == "missing_policy_statement", "high").otherwise("critical")
    return own.unionByName(orphans).withColumn("severity", severity).select(*GAP)


def _refs(own: str, shared: str = "shared_refs") -> Column:
    """References of a link in order, in one text: its own and those of its selection, which are in order."""
    none = F.array().cast("array<string>")
    own, shared = F.coalesce(own, none), F.coalesce(shared, none)
    return F.array_join(F.when(F.size(own) == 0, shared).otherwise(F.sort_array(F.array_union(shared, own))), ", ")


def _selected(links: DataFrame, per: DataFrame) -> DataFrame:
    """``links`` with ``per``'s large values of their selection; links without one have nulls there."""
    alone = links.filter("selection is null").withColumns({c: F.lit(None).cast(per.schema[c].dataType) for c in per.columns if c != "selection"})
    return alone.unionByName(dealt(links.filter("selection is not null"), per).select(*alone.columns))


def alignment_gaps(links: DataFrame, matched: DataFrame, statements: DataFrame, wired: DataFrame | Wired, resources: DataFrame, review_below: float = 0.85, exact: bool = False) -> DataFrame:
    """Links whose reviewed expectations the statement and the code do not meet, a row for each rule that fails.

    ``matched`` names a link's statement, ``wired`` its resources; ``resources`` are
    classified.  A link without expected domains only says so.  ``exact``: other
    domains than the expected ones are gaps, too.
    """
    normal = F.expr(f"transform(expected_domains, d -> {normal_domain(SPARK, 'd')})")
    want = links.withColumn("expected", F.array_distinct(normal))
    blind = want.filter(F.size("expected") == 0).select("link_id", "doc_id", F.lit("classifier_ground_truth_missing").alias("kind"), F.lit("medium").alias("severity"), F.lit("").alias("iac_ref"))
    want = want.filter(F.size("expected") > 0)
    said = want.join(matched.select("link_id", "doc_id", "version_ord", "statement_id").hint("merge"), ["link_id", "doc_id"]).join(statements.select("doc_id", "version_ord", "statement_id", F.col("keywords").alias("policy_domains"), "statement_kind", "strength", "action_polarity", F.col("confidence").alias("sure")).hint("merge"), ["doc_id", "version_ord", "statement_id"])
    differs = reduce(Column.__or__, (F.col(e).isNotNull() & (F.col(e) != F.col(a)) for e, a in (("expected_kind", "statement_kind"), ("expected_strength", "strength"), ("expected_polarity", "action_polarity"))))
    row = lambda t, kind, severity, ref: t.select("link_id", "doc_id", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), ref.alias("iac_ref"))
    none = F.lit("")
    rows = [
        blind,
        row(said.filter(F.col("sure") < review_below), "policy_classifier_review_required", "medium", none),
        row(said.filter(differs), "policy_statement_semantic_mismatch", "critical", none),
        row(said.filter(F.size(F.array_except("expected", "policy_domains")) > 0), "policy_classifier_domain_mismatch", "high", none),
    ]
    wired = _as_wired(wired)
    facts = resources.select(*IDENTITY, "revision", F.col("domains").alias("code_domains"), "posture", F.col("confidence").alias("sure"))
    code = want.join(wired.own, "link_id").join(facts, [*IDENTITY, "revision"])
    refs, domains = F.sort_array(F.collect_set(full_reference())), F.array_distinct(F.flatten(F.collect_list("code_domains")))
    per = code.groupBy("link_id", "doc_id", "expected").agg(domains.alias("code_domains"), refs.alias("refs"))
    shared = None
    if wired.members is not None:
        shared = wired.chosen.join(facts, [*IDENTITY, "revision"])
        of = shared.groupBy("selection")
        known = of.agg(F.sort_array(F.collect_set(full_reference())).alias("shared_refs"))
        # of each member its own and its selection's domains; references are long and join those that need them
        joined = want.join(wired.members, "link_id").join(of.agg(domains.alias("more")), "selection").select("link_id", "doc_id", "expected", "selection", "more")
        per = joined.join(per, ["link_id", "doc_id", "expected"], "full_outer").withColumn("code_domains", F.array_distinct(F.concat(F.coalesce("more", F.array().cast("array<string>")), F.coalesce("code_domains", F.array().cast("array<string>"))))).drop("more")
    tests = [("terraform_classifier_domain_mismatch", F.array_except("expected", "code_domains"))]
    if exact:
        rows.append(row(said.filter(F.size(F.array_except("policy_domains", "expected")) > 0), "policy_classifier_unexpected_domain", "high", none))
        tests.append(("terraform_classifier_unexpected_domain", F.array_except("code_domains", "expected")))
    failed = F.array_compact(F.array(*(F.when(F.size(x) > 0, kind) for kind, x in tests)))
    off = per.withColumn("kinds", failed).filter(F.size("kinds") > 0).drop("code_domains", "expected")
    off = off.withColumn("iac_ref", F.array_join("refs", ", ")) if shared is None else _selected(off, known).withColumn("iac_ref", _refs("refs"))
    rows.append(off.select("link_id", "doc_id", F.explode("kinds").alias("kind"), F.lit("high").alias("severity"), "iac_ref"))
    found = [("terraform_control_violation", "critical", F.col("posture") == "violated"), ("terraform_posture_review_required", "medium", F.col("posture").isin("unknown", "review_required")), ("terraform_classifier_review_required", "medium", F.col("sure") < review_below)]
    rows += [row(code.filter(test), kind, severity, full_reference()) for kind, severity, test in found]
    if shared is None:
        return reduce(DataFrame.unionByName, rows)
    each = reduce(DataFrame.unionByName, (shared.filter(test).select("selection", F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), full_reference().alias("iac_ref")) for kind, severity, test in found))
    return Gaps(reduce(DataFrame.unionByName, rows), each, want.select("link_id", "doc_id").join(wired.members, "link_id")).table()


def unlinked_sensitive(resources: DataFrame, wired: DataFrame | Wired, review_below: float = 0.85) -> DataFrame:
    """Security-sensitive resources that no link reaches: a gap each, high if the classifier is sure, else medium."""
    alone = resources.filter("security_sensitive").join(_as_wired(wired).reached(*IDENTITY, "revision"), [*IDENTITY, "revision"], "left_anti")
    return alone.select("repository", "revision", "module_path", "address", F.lit("unlinked_security_sensitive_resource").alias("kind"), F.when(F.col("confidence") >= review_below, "high").otherwise("medium").alias("severity"))


def iac_change_gaps(delta: DataFrame, links: DataFrame, wired: DataFrame | Wired, sensitive: DataFrame, matched: DataFrame) -> DataFrame:
    """Gaps of changed resources: review of the policy (removed critical, else high), sensitive ones without a link, and anchors that are gone.

    ``wired`` holds the links of both revisions' resources; ``sensitive`` the identities
    that the classifier calls so; ``matched`` the statements of the newer version.
    """
    return code_gaps(delta, links, wired, sensitive, matched).table()


def code_gaps(delta: DataFrame, links: DataFrame, wired: DataFrame | Wired, sensitive: DataFrame, matched: DataFrame) -> Gaps:
    """``iac_change_gaps`` with the reviews that links of a selection share kept once."""
    wired = _as_wired(wired)
    own = wired.own.select("link_id", *IDENTITY).distinct()
    kind, severity = F.concat(F.lit("iac_"), "change", F.lit("_requires_doc_review")).alias("kind"), F.when(F.col("change") == "removed", "critical").otherwise("high").alias("severity")
    shared = members = None
    if wired.members is not None:
        chosen = wired.chosen.select("selection", *IDENTITY).distinct()
        own = own.join(wired.members, "link_id", "left").join(chosen, ["selection", *IDENTITY], "left_anti").select("link_id", *IDENTITY)
        shared = delta.join(chosen, IDENTITY).select("selection", kind, severity, F.col("address").alias("iac_ref"))
        members = links.select("link_id", "doc_id").join(wired.members, "link_id").join(shared.select("selection").distinct(), "selection", "left_semi").select("link_id", "doc_id", "selection")
    met = delta.drop("link_id").join(own, IDENTITY).join(links.select("link_id", "doc_id"), "link_id")
    review = met.select("link_id", "doc_id", kind, severity, F.col("address").alias("iac_ref"))
    by_type = reduce(Column.__or__, (F.contains(F.lower("resource_type"), F.lit(t)) for t in iac_rules.SENSITIVE_TYPES))
    known = sensitive.select(*IDENTITY).distinct().withColumn("is_sensitive", F.lit(True))
    alone = delta.join(wired.reached(*IDENTITY), IDENTITY, "left_anti").join(known, IDENTITY, "left").filter(by_type | F.coalesce("is_sensitive", F.lit(False)))
    alone = alone.select(F.lit("").alias("link_id"), F.lit(None).cast("long").alias("doc_id"), F.lit("unlinked_sensitive_iac_change").alias("kind"), F.lit("high").alias("severity"), full_reference().alias("iac_ref"))
    concerned = review.select("link_id", "doc_id")
    concerned = concerned if members is None else concerned.unionByName(members.select("link_id", "doc_id"))
    gone = concerned.distinct().join(matched.select("link_id").distinct(), "link_id", "left_anti")
    gone = gone.select("link_id", "doc_id", F.lit("doc_anchor_missing_after_iac_change").alias("kind"), F.lit("critical").alias("severity"), F.lit("").alias("iac_ref"))
    return Gaps(review.unionByName(alone).unionByName(gone), shared, members)


def doc_change_gaps(links: DataFrame, older: DataFrame, newer: DataFrame, wired: DataFrame | Wired, changes: DataFrame | None = None) -> DataFrame:
    """Gaps of links whose policy changed: statement gone (critical), reworded (high), or there without code (high).

    ``older`` and ``newer`` are the links' statements in two versions, ``wired`` their resources now.
    ``changes`` (before_id, risk): a rewording of the link's old statement that is a greater risk than high makes its gap so.
    """
    o, n = (t.select("link_id", F.col("content_hash").alias(name)) for t, name in ((older, "old"), (newer, "new")))
    wired = _as_wired(wired)
    refs = wired.own.groupBy("link_id").agg(F.sort_array(F.collect_set(full_reference())).alias("refs"))
    state = links.select("link_id", "doc_id").join(o, "link_id", "left").join(n, "link_id", "left").join(refs, "link_id", "left")
    state = state.withColumn("selection", F.lit(None).cast("string")) if wired.members is None else state.join(wired.members, "link_id", "left")
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    kind = F.when(has_old & ~has_new, "policy_obligation_removed_iac_still_present").when(has_old & has_new & (F.col("old") != F.col("new")), "policy_obligation_changed_verify_iac").when(has_new & F.col("refs").isNull() & F.col("selection").isNull(), "policy_without_iac")
    found = state.withColumn("kind", kind).filter("kind is not null")
    worst = F.lit(3)
    if changes is not None:
        risk = older.select("link_id", F.col("statement_id").alias("before_id")).join(changes.filter("before_id <> ''").groupBy("before_id").agg(F.max(F.expr(severity_rank("risk"))).alias("risk")), "before_id").select("link_id", "risk")
        found = found.join(risk, "link_id", "left")
        worst = F.when(F.contains("kind", F.lit("changed")), F.greatest(F.coalesce("risk", F.lit(3)), F.lit(3))).otherwise(3)
    found = found.withColumn("rank", F.when(F.contains("kind", F.lit("removed")), 4).otherwise(worst))
    if wired.members is None:
        found = found.withColumn("shared_refs", F.array().cast("array<string>"))
    else:  # references are joined last: those of a selection are long, and most links have no gap
        found = _selected(found, wired.chosen.groupBy("selection").agg(F.sort_array(F.collect_set(full_reference())).alias("shared_refs")))
    return found.select("link_id", "doc_id", "kind", F.expr(severity_name("rank")).alias("severity"), _refs("refs").alias("iac_ref"))


def change_set(code: DataFrame | Gaps, docs: DataFrame, complete: DataFrame) -> DataFrame | Gaps:
    """All gaps of a change: of code, of policies, of links in both (coordinated), and completeness gaps that are not there yet.

    Of ``Gaps`` of code the result has the same shared ones.
    """
    plain, code = isinstance(code, DataFrame), _as_gaps(code)
    marked = lambda t: t.withColumn("gone", F.contains("kind", F.lit("removed")))
    worst = [F.max(F.expr(severity_rank("severity"))).alias("rank"), F.max("gone").alias("gone"), F.collect_set(F.nullif("iac_ref", F.lit(""))).alias("refs")]
    of = lambda t: marked(t.filter("link_id <> ''")).groupBy("link_id").agg(F.max("doc_id").alias("doc_id"), *worst)
    d, c = of(docs).toDF("link_id", "doc_id", "d_rank", "d_gone", "d_refs"), of(code.rows).drop("doc_id").toDF("link_id", "c_rank", "c_gone", "c_refs")
    if code.members is None:
        both = d.join(c, "link_id").withColumns({"s_rank": F.lit(0), "s_gone": F.lit(False), "s_refs": F.array().cast("array<string>")})
    else:
        both = d.join(c, "link_id", "left").join(code.members.select("link_id", "selection"), "link_id", "left").filter("c_rank is not null or selection is not null")
        both = _selected(both, marked(code.shared).groupBy("selection").agg(*worst).toDF("selection", "s_rank", "s_gone", "s_refs"))
    gone = reduce(Column.__or__, (F.coalesce(f"{x}_gone", F.lit(False)) for x in "cds"))
    kind = F.when(gone, "coordinated_control_retirement_review").otherwise("coordinated_policy_iac_change")
    refs = F.array_join(F.sort_array(F.array_distinct(F.concat(*(F.coalesce(f"{x}_refs", F.array().cast("array<string>")) for x in "scd")))), ", ")
    coordinated = both.select("link_id", "doc_id", kind.alias("kind"), F.greatest("c_rank", "d_rank", "s_rank").alias("rank"), refs.alias("iac_ref")).withColumn("severity", F.expr(severity_name("rank"))).select(*GAP)
    gaps = code.more(docs).more(coordinated)
    # only gaps of a kind that completeness gaps have can be one of them
    open_ = complete.filter("kind <> 'covered'")
    alike = lambda t: t.join(F.broadcast(open_.select("kind").distinct()), "kind", "left_semi")
    same = Gaps(alike(gaps.rows), None if gaps.shared is None else alike(gaps.shared), gaps.members).table()
    new = open_.join(same.select("kind", "link_id", "iac_ref").distinct(), ["kind", "link_id", "iac_ref"], "left_anti")
    gaps = gaps.more(new)
    return gaps.table() if plain else gaps


def gap_dedupe(gaps: DataFrame | Gaps) -> DataFrame:
    """One gap of each kind, link and reference: the one of the highest severity."""
    gaps = _as_gaps(gaps)
    rank = F.max(F.expr(severity_rank("severity"))).alias("rank")
    named = lambda t: t.withColumn("severity", F.expr(severity_name("rank"))).drop("rank")
    rows = named(gaps.rows.groupBy("kind", "link_id", "iac_ref").agg(F.max("doc_id").alias("doc_id"), rank)).select(*GAP)
    if gaps.members is None:
        return rows
    shared = named(gaps.shared.groupBy("selection", "kind", "iac_ref").agg(rank))
    # a link's row that its selection has, too, has its severity, which follows from the kind
    rows = rows.join(gaps.members.select("link_id", "selection"), "link_id", "left").join(shared, ["selection", "kind", "iac_ref"], "left_anti").select(*GAP)
    return Gaps(rows, shared, gaps.members).table()


def anchor_statements(links: DataFrame) -> DataFrame:
    """A statement for each link, taken from its anchor: ids, domains and confidence as of ``crosswalk.map_statements``.

    The first statement that the anchor holds; if it holds none, one without domains.
    The link's own control_ids follow the cited ones.  statement_id is the link's.
    """
    docs = links.select("doc_id", "link_id", F.col("anchor").alias("markdown"), "control_ids").dropDuplicates(["link_id"])
    # extraction works by document: here each link is one
    numbered = docs.withColumn("n", F.xxhash64("link_id"))
    found = extract.extract_statements(numbered.select(F.col("n").alias("doc_id"), F.lit(1).alias("version_ord"), "markdown")).filter("stmt_ord = 1").select(F.col("doc_id").alias("n"), "text", "keywords", "framework_ids", "confidence")
    none = F.array().cast("array<string>")
    both = numbered.join(found.hint("merge"), "n", "left")
    ids = F.array_distinct(F.concat(F.coalesce("framework_ids", none), F.coalesce("control_ids", none)))
    return both.select("doc_id", F.lit(1).alias("version_ord"), F.col("link_id").alias("statement_id"), F.lit(1).cast("long").alias("stmt_ord"), F.coalesce("text", "markdown").alias("text"), F.coalesce("keywords", none).alias("keywords"), ids.alias("framework_ids"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def scf_map(hits: DataFrame, key: str) -> DataFrame:
    """Control ids by framework of what ``key`` names: a row each of the key's hits (key, framework, controls)."""
    return hits.groupBy(key, "framework").agg(F.sort_array(F.collect_set("control_id")).alias("controls"))


def framework_labels(mapped: DataFrame, key: str) -> DataFrame:
    """Distinct ``framework:control`` labels of a mapping."""
    return mapped.select(key, F.explode("controls").alias("control_id"), "framework").select(key, F.concat_ws(":", "framework", "control_id").alias("label")).distinct()


def mapping_assessments(mapped: DataFrame, assessments: DataFrame) -> DataFrame:
    """Active assessments of a policy (or of all) that use a framework of its mapping, the control backbone aside.

    ``mapped``: doc_id, framework.  Returns doc_id, assessment_id, frameworks.
    """
    active = assessments.filter("status = 'active'").select("assessment_id", "doc_ids", F.explode("frameworks").alias("framework"))
    met = with_assessments(mapped.filter("framework <> 'SCF'").select("doc_id", "framework").distinct(), active)
    return met.groupBy("doc_id", "assessment_id").agg(F.array_join(F.sort_array(F.collect_set("framework")), ",").alias("frameworks"))


def merge_target(gaps: DataFrame | Gaps, target: str) -> DataFrame:
    """Gaps of a target (of ``Gaps``: the link): number, highest severity, status."""
    gaps = _as_gaps(gaps)
    counted = lambda t, by: t.groupBy(by).agg(F.count("*").alias("n"), F.max(F.expr(severity_rank("severity"))).alias("rank"))
    out = counted(gaps.rows, target)
    if gaps.members is not None:
        shared = gaps.members.join(counted(gaps.shared, "selection"), "selection").select("link_id", "n", "rank")
        out = out.unionByName(shared).groupBy(target).agg(F.sum("n").alias("n"), F.max("rank").alias("rank"))
    status = F.when(F.col("rank") >= 3, "misaligned").when(F.col("rank") >= 1, "review_required").otherwise("aligned")
    return out.select(target, "n", F.expr(severity_name("rank")).alias("severity"), status.alias("status"))
