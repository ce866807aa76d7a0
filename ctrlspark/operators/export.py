"""Exported documents: flat rows, and the nested forms made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def document_title(docs: DataFrame) -> DataFrame:
    """The text of each document's first heading; '' if it has none."""
    return docs.select("doc_id", "version_ord", F.regexp_extract("markdown", r"(?m)^\s*#+\s*(.*?)\s*$", 1).alias("title"))


def component_rows(hits: DataFrame) -> DataFrame:
    """800-53 controls of a document version with the first statement that implements each."""
    own = hits.filter("framework = 'NIST 800-53'").withColumn("control", F.upper("control_id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "version_ord", "control").orderBy("stmt_ord", "source"))
    return own.withColumn("first", first).filter("first = 1").select("doc_id", "version_ord", "control", "statement_id", "source")


def assessment_rows(statements: DataFrame, hits: DataFrame, limit: int = 8) -> DataFrame:
    """Binding statements with a title (the last heading) and their first controls in order."""
    controls = hits.groupBy("doc_id", "version_ord", "statement_id").agg(F.slice(F.sort_array(F.collect_set("control_id")), 1, limit).alias("controls"))
    binding = statements.filter(F.col("strength").isin("must", "shall", "prohibited")).join(controls.hint("merge"), ["doc_id", "version_ord", "statement_id"], "left")
    title = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("Obligation"))
    return binding.select("doc_id", "version_ord", "statement_id", title.alias("title"), F.coalesce(F.array_join("controls", ";"), F.lit("")).alias("controls"))


def named_id(*parts: Column | str) -> Column:
    """A UUID that follows from a name: 122 bits of the name's SHA-256, marked as version 8 (a custom hash)."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(13, 3), F.lit("-8"), cut(16, 3), F.lit("-"), cut(19, 12))


def _prop(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.coalesce(value, F.lit("")).alias("value"))


def _metadata(title: str, stamp: str, remarks: Column | None = None) -> Column:
    fields = [F.lit(title).alias("title"), F.lit(stamp).alias("last-modified"), F.lit("0.1.0").alias("version"), F.lit("1.1.2").alias("oscal-version")]
    return F.struct(*fields, *([remarks.alias("remarks")] if remarks is not None else []))


VERSION = ["doc_id", "version_ord"]


def component_definition(statements: DataFrame, hits: DataFrame, title: str, stamp: str) -> DataFrame:
    """A nested component definition of each document version: doc_id, version_ord, definition.

    Its requirements are the 800-53 controls with the first statement that implements
    each; all ids follow from names, so the same content gives the same document.
    ``stamp`` is the time of the last change.  ``to_json`` writes it.
    """
    about = statements.select(*VERSION, "statement_id", "text", "strength")
    rows = component_rows(hits).join(about.hint("merge"), [*VERSION, "statement_id"])
    place = lambda kind, *more: named_id(F.lit(kind), F.concat(F.lit("pol-"), "doc_id"), F.col("version_ord").cast("string"), *more)
    props = F.array(_prop("policy-statement-id", F.col("statement_id")), _prop("obligation-strength", F.col("strength")), _prop("mapping-source", F.col("source")))
    need = F.struct(place("requirement", F.col("control")).alias("uuid"), F.lower("control").alias("control-id"), F.col("text").alias("description"), props.alias("props"))
    needs = rows.withColumn("need", need).groupBy(*VERSION).agg(F.transform(F.array_sort(F.collect_list(F.struct("control", "need"))), lambda x: x["need"]).alias("needs"))
    name = F.concat(F.lit("document pol-"), "doc_id")
    impl = F.struct(place("implementation").alias("uuid"), F.lit("NIST SP 800-53 Rev. 5").alias("source"), F.lit("Controls that follow from the policy's duties").alias("description"), F.col("needs").alias("implemented-requirements"))
    part = F.struct(place("component").alias("uuid"), F.lit("policy").alias("type"), F.lit(title).alias("title"), F.concat(F.lit("Policy taken from "), name).alias("description"), F.array(impl).alias("control-implementations"))
    whole = F.struct(F.struct(place("definition").alias("uuid"), _metadata(title, stamp, F.concat(F.lit("Made from "), name)).alias("metadata"), F.array(part).alias("components")).alias("component-definition"))
    return needs.select(*VERSION, whole.alias("definition"))


def assessment_results(statements: DataFrame, hits: DataFrame, title: str, stamp: str, limit: int = 8) -> DataFrame:
    """A nested list of results of each document version, one for each binding statement: doc_id, version_ord, results."""
    order = F.row_number().over(Window.partitionBy(*VERSION, "statement_id").orderBy("source", "hit_ord", "framework", "control_id"))
    first = hits.withColumn("nth", order).filter(F.col("nth") <= limit)
    named = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(":", "framework", "control_id").alias("c")))), lambda x: x["c"])
    mapped = first.groupBy(*VERSION, "statement_id").agg(F.array_join(named, ", ").alias("mapped"))
    rows = statements.filter(F.col("strength").isin("must", "shall", "prohibited")).join(mapped.hint("merge"), [*VERSION, "statement_id"], "left")
    props = F.array(_prop("statement-id", F.col("statement_id")), _prop("mapped-controls", F.col("mapped")))
    heading = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit("Obligation"))
    place = lambda kind, *more: named_id(F.lit(kind), F.concat(F.lit("pol-"), "doc_id"), F.col("version_ord").cast("string"), *more)
    result = F.struct(place("result", F.col("statement_id")).alias("uuid"), heading.alias("title"), F.col("text").alias("description"), props.alias("props"), F.struct(F.lit("satisfied_as_documented").alias("state")).alias("status"))
    held = rows.withColumn("result", result).groupBy(*VERSION).agg(F.transform(F.array_sort(F.collect_list(F.struct("stmt_ord", "result"))), lambda x: x["result"]).alias("held"))
    whole = F.struct(F.struct(place("results").alias("uuid"), _metadata(title, stamp).alias("metadata"), F.col("held").alias("results")).alias("assessment-results"))
    return held.select(*VERSION, whole.alias("results"))


def indicator_coverage(hits: DataFrame, ksi: DataFrame, class_id: str) -> DataFrame:
    """Distinct indicators of a document version that apply to a class: those demanded and the optional ones."""
    status = ksi.select(F.col("ksi_id").alias("control_id"), F.col(class_id).alias("status")).filter("status <> 'not_applicable'")
    met = hits.filter("source = 'ksi'").select("doc_id", "version_ord", "control_id").distinct().join(status, "control_id")
    return met.groupBy("doc_id", "version_ord").agg(F.count(F.when(F.col("status") != "optional", 1)).alias("demanded"), F.count(F.when(F.col("status") == "optional", 1)).alias("optional"))
