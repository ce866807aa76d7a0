"""Crosswalk of statements to framework controls: joins with catalogs.

A hit is (doc_id, version_ord, statement_id, stmt_ord, source, hit_ord, framework,
control_id, title, relationship, confidence).  Catalogs stay tables; the planner
broadcasts them when they are small.  Statements and what is derived from them are
never broadcast: joins of two such tables are sort-merge joins, as a compressed
file's size says little about the size of its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dialect import SPARK
from ..functions.phrases import phrases_in
from ..sources.tables import staged

KEY = ["doc_id", "version_ord", "statement_id", "stmt_ord"]
HIT = [*KEY, "source", "hit_ord", "framework", "control_id", "title", "relationship", "confidence"]
#: frameworks that a control expands to, in order
TARGETS = ("NIST 800-53", "ISO 27001", "SOC 2", "NIST CSF 2.0", "CIS Controls", "PCI DSS")


def _hit(rows: DataFrame, source: str, order, relationship: str, confidence) -> DataFrame:
    return rows.select(*KEY, F.lit(source).alias("source"), order.cast("long").alias("hit_ord"), "framework", "control_id", "title", F.lit(relationship).alias("relationship"), confidence.alias("confidence"))


def seed_hits(statements: DataFrame, seed: DataFrame) -> DataFrame:
    """Controls of the topics that a statement's domains name."""
    topics = statements.select(*KEY, F.posexplode("keywords").alias("k", "domain"))
    return _hit(topics.join(seed, "domain"), "seed", F.col("k") * 1000 + F.col("ord"), "topic", F.lit(0.55))


def explicit_hits(statements: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One hit for each cited id; titles of cited 800-53 controls come from ``titles(control_id, title)``."""
    cited = statements.select(*KEY, F.posexplode("framework_ids").alias("k", "control_id")).withColumn("framework", F.expr(rules.framework(SPARK, "control_id")))
    if titles is None:
        cited = cited.withColumn("title", F.lit(""))
    else:
        cited = cited.join(titles.select("control_id", "title"), "control_id", "left").withColumn("title", F.coalesce(F.when(F.col("framework") == "NIST 800-53", F.col("title")), F.lit("")))
    return _hit(cited, "explicit-citation", F.col("k"), "cited", F.lit(0.95))


def normalize_nist_id(column: str) -> str:
    """SQL: an 800-53 id with its number padded to two digits; other ids in upper case."""
    shape = r'r"(?i)^([A-Z]{2})-0*(\d+)(.*)$"'
    return f"case when regexp_like({column}, {shape}) then upper(concat(regexp_extract({column}, {shape}, 1), '-', lpad(regexp_extract({column}, {shape}, 2), greatest(2, length(regexp_extract({column}, {shape}, 2))), '0'), regexp_extract({column}, {shape}, 3))) else upper({column}) end"


def lookup_key_variants(ids: DataFrame) -> DataFrame:
    """(control_id, framework, variant_ord, variant): spellings under which an id may stand in a catalog, in order."""
    bare = r"""case when framework = 'CIS Controls' then array(trim(regexp_replace(control_id, r"(?i)^CIS\s*", '')), concat('CIS ', trim(regexp_replace(control_id, r"(?i)^CIS\s*", ''))))
        when framework = 'PCI DSS' then array(trim(regexp_replace(control_id, r"(?i)^Req\.?\s*", '')), concat('Req.', trim(regexp_replace(control_id, r"(?i)^Req\.?\s*", '')))) else cast(array() as array<string>) end"""
    forms = F.expr(f"array_distinct(filter(concat(array(control_id, upper(control_id), lower(control_id), {normalize_nist_id('control_id')}), {bare}), v -> v <> ''))")
    return ids.select("control_id", "framework", F.posexplode(forms).alias("variant_ord", "variant"))


def framework_to_scf(ids: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(control_id, framework, scf_id, ord): catalog controls of the first spelling that the catalog knows."""
    reverse = crosswalk.select("framework", F.col("control_id").alias("variant"), "scf_id", "ord")
    found = lookup_key_variants(ids.select("control_id", "framework").distinct()).join(reverse, ["framework", "variant"])
    best = F.min("variant_ord").over(Window.partitionBy("control_id", "framework"))
    return found.withColumn("best", best).filter("variant_ord = best").select("control_id", "framework", "scf_id", "ord")


def scf_ids(statements: DataFrame, scf: DataFrame, crosswalk: DataFrame, domain_limit: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """(statement, scf_id, place): catalog controls of the cited ids, else (nothing cited or found) of the domains.

    Columns of ``keep`` pass unchanged.
    """
    key = [*KEY, *keep]
    cited = statements.select(*key, F.posexplode("framework_ids").alias("k", "control_id")).withColumn("framework", F.expr(rules.framework(SPARK, "control_id")))
    own = cited.join(scf.select("control_id"), "control_id", "left_semi").select(*key, F.col("control_id").alias("scf_id"), (F.col("k") * 1000).alias("place"))
    through = cited.join(framework_to_scf(cited, crosswalk).hint("merge"), ["control_id", "framework"]).select(*key, "scf_id", (F.col("k") * 1000 + F.col("ord")).alias("place"))
    topics = statements.filter("size(framework_ids) = 0").select(*key, F.posexplode("keywords").alias("k", "domain"))
    few = scf.withColumn("nth", F.row_number().over(Window.partitionBy("domain").orderBy("ord"))).filter(F.col("nth") <= domain_limit)
    topical = topics.join(few.select("domain", F.col("control_id").alias("scf_id"), "nth"), "domain").select(*key, "scf_id", (F.col("k") * 1000 + F.col("nth")).alias("place"))
    every = own.unionByName(through).unionByName(topical)
    return every.groupBy(*key, "scf_id").agg(F.min("place").cast("long").alias("place"))


def scf_hits(statements: DataFrame, scf: DataFrame, crosswalk: DataFrame, controls: int = 12, per_framework: int = 4, expand: int = 24) -> DataFrame:
    """Backbone hits of the first controls, then their crosswalks, dealt out in turns.

    Every control gives its k-th crosswalk before any gives its next one, up to
    ``expand`` in all.  Confidences are capped by the statement's own.  The chosen controls, which
    both kinds of hits read, are written once to the shared folder.
    """
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("place", "scf_id"))
    about = statements.withColumns({"own": F.col("confidence"), "cited": F.size("framework_ids") > 0})
    chosen = scf_ids(about, scf, crosswalk, keep=("own", "cited")).withColumn("nth", nth).filter(F.col("nth") <= controls)
    chosen = staged(chosen, "chosen")
    names = scf.select(F.col("control_id").alias("scf_id"), "title")
    spine = chosen.join(names, "scf_id", "left").select(*KEY, F.lit("SCF").alias("framework"), F.col("scf_id").alias("control_id"), F.coalesce("title", F.lit("")).alias("title"), "nth", F.least(F.when(F.col("cited"), 0.9).otherwise(0.72), F.when(F.col("own") > 0, F.col("own")).otherwise(1.0)).alias("c"))
    rank = F.expr("case framework " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(TARGETS)) + " end")
    cross = crosswalk.withColumn("target", rank).filter("target is not null").withColumn("in_fw", F.row_number().over(Window.partitionBy("scf_id", "framework").orderBy("ord"))).filter(F.col("in_fw") <= per_framework)
    cross = cross.withColumn("turn", F.row_number().over(Window.partitionBy("scf_id").orderBy("target", "in_fw")))
    spread = chosen.join(cross.select("scf_id", "framework", "control_id", "turn"), "scf_id")
    spread = spread.withColumn("out", F.row_number().over(Window.partitionBy(*KEY).orderBy("turn", "nth"))).filter(F.col("out") <= expand)
    spread = spread.select(*KEY, "framework", "control_id", F.lit("").alias("title"), "out", F.least(F.lit(0.88), F.when(F.col("own") > 0, F.col("own")).otherwise(1.0)).alias("c"))
    return _hit(spine, "scf", F.col("nth"), "backbone", F.col("c")).unionByName(_hit(spread, "scf", F.col("out") + 100, "scf-crosswalk", F.col("c")))


def ksi_by_control(statements: DataFrame, ksi: DataFrame) -> DataFrame:
    """Indicators whose control has the base id (without its enhancement) of a cited one."""
    base = lambda c: F.expr(rf"""upper(regexp_replace({c}, r"[.(]\d+\)?$", ''))""")
    cited = statements.select(*KEY, F.explode("framework_ids").alias("cited")).filter(r"""regexp_like(cited, r"^[A-Z]{2}-\d+")""").withColumn("base", base("cited"))
    return cited.join(ksi.withColumn("base", base("control")), "base").select(*KEY, "ksi_id", "ord").distinct()


def ksi_by_topic(statements: DataFrame, ksi: DataFrame, words: DataFrame) -> DataFrame:
    """Indicators of the groups one of whose words stands in the text."""
    low = statements.select(*KEY, F.lower("text").alias("low"))
    groups = phrases_in(low, "low", words, "word").join(words.select("word", "grp"), "word").select(*KEY, "grp").distinct()
    return groups.join(ksi.withColumn("grp", F.split("ksi_id", "-")[1]), "grp").select(*KEY, "ksi_id", "ord").distinct()


def ksi_hits(statements: DataFrame, ksi: DataFrame, words: DataFrame, class_id: str | None = None) -> DataFrame:
    """Indicator hits: by control (0.9) before topic (0.55), each indicator once; of a class only those that apply."""
    if class_id:
        ksi = ksi.filter(F.coalesce(F.col(class_id), F.lit("not_applicable")) != "not_applicable")
    both = ksi_by_control(statements, ksi).withColumn("c", F.lit(0.9)).unionByName(ksi_by_topic(statements, ksi, words).withColumn("c", F.lit(0.55)))
    best = both.groupBy(*KEY, "ksi_id", "ord").agg(F.max("c").alias("c")).withColumns({"framework": F.lit("FedRAMP KSI"), "control_id": F.col("ksi_id"), "title": F.lit("")})
    return _hit(best, "ksi", F.when(F.col("c") > 0.6, F.col("ord")).otherwise(F.col("ord") + 1000), "map", F.col("c"))


def hit_dedupe(hits: DataFrame) -> DataFrame:
    """The first hit of each (source, framework, control) of a statement; empty ids go."""
    first = F.row_number().over(Window.partitionBy(*KEY, "source", "framework", "control_id").orderBy("hit_ord"))
    return hits.filter("control_id <> ''").withColumn("first", first).filter("first = 1").drop("first")


def hit_parts(statements: DataFrame, scf: DataFrame, crosswalk: DataFrame, seed: DataFrame, ksi: DataFrame, words: DataFrame) -> list[Callable[[], DataFrame]]:
    """All hits, source by source: catalog, seed, citations, indicators.

    Hits of different sources never exclude each other, so each source is a job of its own
    and the driver plans and broadcasts for one at a time.
    """
    parts = (lambda: scf_hits(statements, scf, crosswalk), lambda: seed_hits(statements, seed), lambda: explicit_hits(statements), lambda: ksi_hits(statements, ksi, words))
    return [lambda part=part: hit_dedupe(part()) for part in parts]


def map_statements(statements: DataFrame, scf: DataFrame, crosswalk: DataFrame, seed: DataFrame, ksi: DataFrame, words: DataFrame) -> DataFrame:
    """All hits as one table."""
    return reduce(DataFrame.unionByName, (part() for part in hit_parts(statements, scf, crosswalk, seed, ksi, words)))


def scf_reverse(controls: DataFrame, crosswalk: DataFrame, reverse: DataFrame, most: int = 8) -> DataFrame:
    """Framework ids of backbone controls that have no crosswalk of their own, from a table read the other way round: control_id, framework, other, nth.

    ``controls``: control_id; ``crosswalk``: scf_id; ``reverse``: framework, control_id, scf_ids in order of ``ord``.
    """
    bare = controls.select("control_id").distinct().join(crosswalk.select(F.col("scf_id").alias("control_id")).distinct(), "control_id", "left_anti")
    met = reverse.select("framework", F.col("control_id").alias("other"), "ord", F.explode("scf_ids").alias("control_id")).join(bare, "control_id")
    nth = F.row_number().over(Window.partitionBy("control_id").orderBy("ord", "framework", "other"))
    return met.withColumn("nth", nth).filter(F.col("nth") <= most).select("control_id", "framework", "other", "nth")


def snapshot_hits(statements: DataFrame, snapshot: DataFrame, most: int = 10) -> DataFrame:
    """Hits of cited control families in a snapshot (prefix, target, control_id, title, ord), at 0.85: AC and IA ids go to one target, CC ids to another."""
    cited = statements.select(*KEY, F.posexplode("framework_ids").alias("k", "cited")).withColumn("prefix", F.upper(F.regexp_extract("cited", r"^([A-Za-z]{2})", 1)))
    met = cited.join(snapshot, "prefix").withColumn("hit_ord", F.row_number().over(Window.partitionBy(*KEY).orderBy("k", "ord")))
    return met.filter(F.col("hit_ord") <= most).select(*KEY, F.col("target").alias("framework"), "control_id", "title", "hit_ord", F.lit(0.85).alias("confidence"))


def section_hits(statements: DataFrame, sections: DataFrame, most: int = 8) -> DataFrame:
    """Sections of a snapshot(section_id, name, ord) whose id or name holds one of a statement's terms, at 0.7.

    Terms are the first two cited ids, else the first domain with blanks for
    underscores.  One automaton of all distinct terms reads each section, then statements meet terms.
    """
    terms = F.when(F.size("framework_ids") > 0, F.slice("framework_ids", 1, 2)).otherwise(F.transform(F.slice("keywords", 1, 1), lambda k: F.replace(k, F.lit("_"), F.lit(" "))))
    asked = statements.select(*KEY, F.posexplode(terms).alias("k", "term")).withColumn("term", F.lower("term"))
    hay = F.lower(F.concat_ws(" ", "section_id", "name"))
    met = phrases_in(sections.select("section_id", "name", "ord", hay.alias("hay")), "hay", asked, "term").drop("hay")
    found = asked.join(met.hint("merge"), "term").groupBy(*KEY, "section_id", "name").agg(F.min(F.struct("k", "ord")).alias("place"))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("place", "section_id"))
    return found.withColumn("hit_ord", nth).filter(F.col("hit_ord") <= most).select(*KEY, "section_id", "name", "hit_ord", F.lit(0.7).alias("confidence"))
