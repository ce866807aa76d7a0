"""Documents, links, assessments, alerts and catalogs as files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.change_rules import severity_rank
from ..functions.dialect import SPARK
from ..functions.rules import normal_domain

SUFFIXES = ("md", "markdown", "txt")
LINK = "link_id string, doc_id string, statement_anchor string, statement_keywords array<string>, expected_domains array<string>, expected_statement_kind string, expected_strength string, expected_action_polarity string, terraform_addresses array<string>, terraform_resource_types array<string>, iac_paths array<string>, iac_repositories array<string>, control_ids array<string>"
ASSESSMENT = "assessment_id string, name string, frameworks array<string>, doc_ids array<string>, owner string, status string, due_date string, fedramp_class string, certification_type string"
CLASSES = ("a", "b", "c", "d")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files below a folder: path, source_hash (of the bytes), markdown, error (for a suffix that is not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    fine = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*SUFFIXES)
    return files.select("path", F.sha2("content", 256).alias("source_hash"), F.when(fine, F.decode("content", "UTF-8")).alias("markdown"), F.when(~fine, "unsupported suffix").alias("error"))


def _listed(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold a bare list or an object with the list in ``field``."""
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{_struct(schema)}>>")
    inside = F.from_json("value", f"struct<{field}: array<struct<{_struct(schema)}>>>")
    rows = F.when(F.ltrim("value").startswith("["), bare).otherwise(inside[field])
    return text.select(F.explode(rows).alias("r")).select("r.*")


def _struct(schema: str) -> str:
    return ", ".join(": ".join(part.split(" ", 1)) for part in schema.split(", "))


def load_links(spark: SparkSession, path: str) -> DataFrame:
    """Links of manifest files, with expected domains normalised."""
    normal = F.expr(f"transform(expected_domains, d -> {normal_domain(SPARK, 'd')})")
    return _listed(spark, path, "links", LINK).withColumn("expected_domains", normal)


def link_violations(links: DataFrame) -> DataFrame:
    """What is wrong with a manifest: link ids that come twice or are missing, and links without expected semantics."""
    n = F.count("*").over(Window.partitionBy("link_id"))
    r = links.withColumn("n", n)
    problems = F.filter(F.array(
        F.when(F.coalesce("link_id", F.lit("")) == "", "link_id missing"), F.when(F.col("n") > 1, "link_id not unique"),
        *(F.when(F.col(c).isNull(), f"{c} missing") for c in ("expected_kind", "expected_strength", "expected_polarity"))), lambda x: x.isNotNull())
    return r.select("link_id", F.explode(problems).alias("problem")).distinct()


#: fields of a manifest and of a link; those that must be there; and the values of those that have a fixed set
MANIFEST_FIELDS = ("schema_version", "links")
LINK_FIELDS = (
    "link_id", "doc_id", "statement_anchor", "statement_keywords", "control_ids", "iac_repositories", "iac_paths", "terraform_addresses", "terraform_resource_types", "tags",
    "expected_domains", "expected_statement_kind", "expected_strength", "expected_action_polarity", "owner", "direction", "notes",
)
DEMANDED = ("link_id", "doc_id", "expected_statement_kind", "expected_strength", "expected_action_polarity")
VALUES = {
    "expected_statement_kind": ("obligation", "prohibition", "recommendation", "permission", "responsibility", "control_description", "citation"),
    "expected_strength": ("must", "shall", "should", "may", "prohibited", "descriptive"),
    "expected_action_polarity": ("positive", "negative"),
}


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """What is wrong with raw link manifests(path, value): path, link_id ('' for the whole file), problem.

    Looks at the JSON before any schema is laid over it, so that a field that nobody
    reads is found: text that is no JSON object, unknown fields of the manifest or of
    a link, a schema_version other than 1, no list of links, link fields that are
    missing or have a value outside their set, and link ids that come twice in a file.
    """
    raw = "map<string,string>"
    top = manifests.select("path", F.from_json("value", raw).alias("top"), F.from_json(F.get_json_object("value", "$.links"), f"array<{raw}>").alias("links"))
    listed = lambda *xs: F.array(*map(F.lit, xs))
    said = lambda text, xs: F.transform(xs, lambda x: F.concat(F.lit(text), x))
    when = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    good = F.col("top").isNotNull()
    whole = F.concat(
        when(~good, "not a JSON object"), F.when(good, said("unknown field ", F.array_sort(F.array_except(F.map_keys("top"), listed(*MANIFEST_FIELDS))))).otherwise(F.array().cast("array<string>")),
        when(good & ~F.coalesce(at("top", "schema_version") == "1", F.lit(False)), "schema_version is not 1"), when(good & F.col("links").isNull(), "no list of links"))
    files = top.select("path", F.lit("").alias("link_id"), F.explode(whole).alias("problem"))
    each = top.select("path", F.posexplode("links").alias("place", "link")).filter("link is not null").withColumn("link_id", F.coalesce(at("link", "link_id"), F.lit("")))
    each = each.withColumn("n", F.count("*").over(Window.partitionBy("path", "link_id")))
    empty = lambda k: F.coalesce(at("link", k), F.lit("")) == ""
    problems = F.concat(
        said("unknown field ", F.array_sort(F.array_except(F.map_keys("link"), listed(*LINK_FIELDS)))), *(when(empty(k), f"{k} missing") for k in DEMANDED),
        *(when(~empty(k) & ~at("link", k).isin(*vs), f"{k} has no such value") for k, vs in VALUES.items()), when((F.col("n") > 1) & (F.col("link_id") != ""), "link_id not unique"))
    return files.unionByName(each.select("path", "link_id", F.explode(problems).alias("problem"))).distinct()


def load_assessments(spark: SparkSession, path: str) -> DataFrame:
    """Assessments of registry files; one without a status is active, one without frameworks or documents has empty lists (all documents)."""
    none = F.array().cast("array<string>")
    return _listed(spark, path, "assessments", ASSESSMENT).withColumns({"status": F.coalesce("status", F.lit("active")), "frameworks": F.coalesce("frameworks", none), "doc_ids": F.coalesce("doc_ids", none)})


def active_assessments(assessments: DataFrame) -> DataFrame:
    return assessments.filter("status = 'active'")


def with_assessments(rows: DataFrame, active: DataFrame) -> DataFrame:
    """``rows`` (doc_id, framework, ...) with the assessments(assessment_id, framework, doc_ids) of their framework and document; an empty doc_ids means all documents.

    Named documents are keys of the join: rows and assessments do not meet by framework alone.
    """
    everywhere = rows.join(active.filter("size(doc_ids) = 0").drop("doc_ids"), "framework")
    named = active.withColumn("doc_id", F.explode(F.array_distinct("doc_ids"))).drop("doc_ids")
    return everywhere.unionByName(rows.join(named.hint("merge"), ["framework", "doc_id"]))


def upsert_assessments(held: DataFrame, new: DataFrame) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those of the same id."""
    return held.join(new.select("assessment_id"), "assessment_id", "left_anti").unionByName(new)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts as JSON lines."""
    alerts.write.mode("append").json(path)


def alert_index(alerts: DataFrame) -> DataFrame:
    """The short row of each alert: id, document, versions and severity."""
    return alerts.select("alert_id", "doc_id", "older", "newer", "severity")


def read_alerts(alerts: DataFrame, min_severity: str = "info") -> DataFrame:
    """Alerts of at least a severity; unknown ones count as info."""
    rank = lambda x: F.expr(severity_rank(x))
    return alerts.filter(rank("severity") >= rank(f"'{min_severity}'"))


def report_rows(statements: DataFrame, hits: DataFrame) -> DataFrame:
    """One nested report per document version: statements in order, each with its hits; to be written as JSON."""
    key = ["doc_id", "version_ord", "statement_id"]
    own = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("source", "hit_ord", "framework", "control_id", "title", "relationship", "confidence"))).alias("hits"))
    full = statements.select(*key, "stmt_ord", "text", "strength").join(own.hint("merge"), key, "left")
    row = F.struct("stmt_ord", "statement_id", "text", "strength", F.coalesce("hits", F.array().cast(own.schema["hits"].dataType)).alias("hits"))
    return full.groupBy("doc_id", "version_ord").agg(F.array_sort(F.collect_list(row)).alias("statements"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def write_csv(table: DataFrame, path: str) -> None:
    """A flat rollup as CSV with a header."""
    table.write.mode("overwrite").csv(path, header=True)


def catalog_flatten(rules: DataFrame) -> DataFrame:
    """Indicators of rule documents (``rules(value)``: JSON text): domain, id, name, controls, and the status for each class.

    A class that an indicator lists is optional if its statement begins so, else what
    its force says; of classes not listed a is optional and d required; an indicator
    without classes is applicable to all.
    """
    entry = "struct<statement: string, force: string>"
    schema = f"struct<KSI: map<string, struct<id: string, name: string, short_name: string, indicators: map<string, struct<name: string, statement: string, controls: array<string>, varies_by_class: map<string, {entry}>>>>>>"
    domains = rules.select(F.explode(F.from_json("value", schema)["KSI"]).alias("key", "d"))
    i = domains.select(F.coalesce("d.short_name", "key").alias("domain"), F.explode("d.indicators").alias("ksi_id", "i"))
    body = lambda c: F.try_element_at("i.varies_by_class", F.lit(c))

    def status(c: str):
        listed = F.when(F.lower(F.trim(F.coalesce(body(c)["statement"], F.lit("")))).startswith("**optional:**"), "optional").otherwise(F.lower(F.coalesce(F.nullif(body(c)["force"], F.lit("")), F.lit("required"))))
        other = {"a": F.lit("optional"), "d": F.lit("required")}.get(c, F.lit(None).cast("string"))
        return F.when(F.col("i.varies_by_class").isNull(), "applicable").when(body(c).isNotNull(), listed).otherwise(other).alias(c)

    nist = F.transform(F.coalesce("i.controls", F.array().cast("array<string>")), lambda x: F.regexp_replace(F.upper(x), r"^([^-.]+)-([^.]*)\.(.*)$", "$1-$2($3)"))
    return i.select("domain", "ksi_id", F.col("i.name").alias("name"), F.array_join(nist, ",").alias("controls"), *map(status, CLASSES))


def doc_matrix(requirements: DataFrame) -> DataFrame:
    """Documentation duties by class from ``requirements(req_id, name, statement, by_class: map of force and timeframe)``.

    A class that is listed has its own force, others are APPLICABLE if there is a general statement.
    """
    every = requirements.withColumn("class_id", F.explode(F.array(*map(F.lit, CLASSES))))
    own = F.try_element_at("by_class", F.col("class_id"))
    force = F.when(own.isNotNull(), own).when(F.coalesce("statement", F.lit("")) != "", "APPLICABLE")
    return every.select("req_id", "name", "class_id", force.alias("force")).filter("force is not null")


def doc_musts(matrix: DataFrame) -> DataFrame:
    return matrix.filter(F.upper("force") == "MUST")


def documentation_actions(impacted: DataFrame, assessments: DataFrame, musts: DataFrame, cadences: DataFrame | None = None) -> DataFrame:
    """For each impacted assessment with a class, the first four documents that must be kept up to date, and how often the package ('' if not set).

    ``cadences``: class_id, number, unit of the package's maintenance.
    """
    names = musts.groupBy("class_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list(F.struct("req_id", F.concat(F.col("req_id"), F.lit(" ("), F.col("name"), F.lit(")")).alias("label"))))["label"], 1, 4), ", ").alias("documents"))
    often = names.select("class_id", F.lit("").alias("cadence")) if cadences is None else cadences.select("class_id", F.concat_ws(" ", "number", "unit").alias("cadence"))
    own = assessments.filter("class_id <> ''").select("assessment_id", "class_id")
    return impacted.select("assessment_id").distinct().join(own, "assessment_id").join(names, "class_id").join(often, "class_id", "left").select("assessment_id", "class_id", "documents", F.coalesce("cadence", F.lit("")).alias("cadence"))


def control_titles(catalog: DataFrame) -> DataFrame:
    """id and title of all controls in ``catalog(value)``: JSON with groups, their controls and the controls below these."""
    control = "id: string, title: string"
    schema = f"struct<catalog: struct<groups: array<struct<controls: array<struct<{control}, controls: array<struct<{control}>>>>>>>>"
    c = catalog.select(F.explode(F.from_json("value", schema)["catalog"]["groups"]).alias("g")).select(F.explode("g.controls").alias("c"))
    pick = lambda t, x: t.select(F.upper(f"{x}.id").alias("control_id"), F.col(f"{x}.title").alias("title"))
    return pick(c, "c").unionByName(pick(c.select(F.explode("c.controls").alias("k")), "k"))
