"""Registered queries over the policy corpus, and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import change_rules, iac_rules, rules
from ..functions.dialect import DUCK, SPARK
from ..operators import coverage, crosswalk, evaluate, export, extract, iac, impact, lineage, monitor, reconcile, registry
from ..sources import infra
from ..sources.catalogs import catalog, catalog_sql
from ..sources.corpus import policies, rewordings, rewordings_sql
from ..sources.tables import built
from .oracle import with_steps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None, more: dict[str, str] | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = with_steps(sql, more)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir, "statements", lambda: extract.extract_corpus(policies(spark, sf_dir)))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.structured_lines(policies(spark, sf_dir))


path = lambda c: F.array_join(c, " > ")

register("lines_explode", lambda s, d: extract.lines_explode(policies(s, d)).select("doc_id", "version_ord", F.col("line_ord").cast("long").alias("line_ord"), "line", F.col("offset").alias("start")), 'select doc_id, version_ord, cast(line_ord as bigint) as line_ord, line, "offset" as start from lines')
register("fence_filter", lambda s, d: extract.fence_filter(extract.lines_explode(policies(s, d))).groupBy("doc_id", "version_ord", "kind").agg(F.count("*").alias("n")), "select doc_id, version_ord, kind, count(*) as n from kinds group by all")
register("page_fill", lambda s, d: _lines(s, d).select("doc_id", "version_ord", F.col("line_ord").cast("long").alias("line_ord"), F.coalesce("page", F.lit(0)).alias("page")), "select doc_id, version_ord, cast(line_ord as bigint) as line_ord, coalesce(page, 0) as page from structured")
register("heading_path", lambda s, d: _lines(s, d).select("doc_id", "version_ord", F.col("line_ord").cast("long").alias("line_ord"), path("heading_path").alias("heading")), "select doc_id, version_ord, cast(line_ord as bigint) as line_ord, array_to_string(heading_path, ' > ') as heading from structured")
register("table_rows", lambda s, d: extract.table_rows(_lines(s, d)).select("doc_id", "version_ord", "text", F.col("start").cast("long").alias("start")), "select doc_id, version_ord, text, cast(start as bigint) as start from rows_")
register("block_assembly", lambda s, d: extract.block_assembly(policies(s, d)).select("doc_id", "version_ord", "text", F.col("start").cast("long").alias("start"), path("heading_path").alias("heading"), F.coalesce("page", F.lit(0)).alias("page")), "select doc_id, version_ord, text, cast(start as bigint) as start, array_to_string(heading_path, ' > ') as heading, coalesce(page, 0) as page from blocks")
register("list_lead", lambda s, d: extract.list_lead(extract.prose_blocks(_lines(s, d))).select("doc_id", "version_ord", "text", F.col("start").cast("long").alias("start")), "select doc_id, version_ord, b.text, cast(start as bigint) as start from blocks b where not exists (select 1 from rows_ r where r.doc_id = b.doc_id and r.version_ord = b.version_ord and r.line_ord = b.line_ord)")
register("sentence_split", lambda s, d: extract.sentence_split(extract.block_assembly(policies(s, d))).select("doc_id", "version_ord", F.col("sent_ord").cast("long").alias("sent_ord"), "sentence"), "select doc_id, version_ord, cast(sent_ord as bigint) as sent_ord, sentence from sentences")
register("clause_split", lambda s, d: extract.clause_split(extract.sentence_split(extract.block_assembly(policies(s, d)))).select("doc_id", "version_ord", "clause"), "select doc_id, version_ord, clause from clauses")
_FLAT = ("doc_id", "version_ord", "stmt_ord", "statement_id", "text", "page", "statement_kind", "strength", "action_polarity", "confidence", "status", "content_hash", "span_start", "span_end")
register("extract_statements", lambda s, d: statements(s, d).select(*_FLAT, F.array_join("keywords", ",").alias("domains"), F.array_join("framework_ids", ",").alias("ids"), path("heading_path").alias("heading")), f"select {', '.join(_FLAT)}, array_to_string(keywords, ',') as domains, array_to_string(framework_ids, ',') as ids, array_to_string(heading_path, ' > ') as heading from statements")


# --- crosswalk -------------------------------------------------------------
_K = "doc_id, version_ord, statement_id, stmt_ord"
_H = f"{_K}, source, cast(hit_ord as bigint) as hit_ord, framework, control_id, title, relationship, round(confidence, 4) as confidence"
_COL = ("doc_id", "version_ord", "statement_id", "stmt_ord", "source", "hit_ord", "framework", "control_id", "title", "relationship")
_NIST = "case when regexp_matches({c}, '(?i)^([A-Z]{{2}})-0*(\\d+)(.*)$') then upper(regexp_extract({c}, '(?i)^([A-Z]{{2}})', 1) || '-' || lpad(regexp_extract({c}, '(?i)^[A-Z]{{2}}-0*(\\d+)', 1), cast(greatest(2, length(regexp_extract({c}, '(?i)^[A-Z]{{2}}-0*(\\d+)', 1))) as integer), '0') || regexp_extract({c}, '(?i)^[A-Z]{{2}}-0*\\d+(.*)$', 1)) else upper({c}) end"
_TARGET = "case framework " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(crosswalk.TARGETS)) + " end"
HITS = {f"c_{n}": catalog_sql(n) for n in ("seed", "scf", "scf_crosswalk", "ksi", "ksi_words")} | {
    "topics": f"select {_K}, unnest(keywords) as domain, generate_subscripts(keywords, 1) - 1 as k from statements",
    "h_seed": f"select {_K}, 'seed' as source, k * 1000 + ord as hit_ord, framework, control_id, title, 'topic' as relationship, 0.55::double as confidence from topics join c_seed using (domain)",
    "cited": f"select *, {rules.framework(DUCK, 'control_id')} as framework from (select {_K}, unnest(framework_ids) as control_id, generate_subscripts(framework_ids, 1) - 1 as k from statements)",
    "h_cited": f"select {_K}, 'explicit-citation' as source, k as hit_ord, framework, control_id, '' as title, 'cited' as relationship, 0.95::double as confidence from cited",
    "variants0": f"""select control_id, framework, [control_id, upper(control_id), lower(control_id), {_NIST.format(c='control_id')}] || case when framework = 'CIS Controls' then [trim(regexp_replace(control_id, '(?i)^CIS\\s*', '')), 'CIS ' || trim(regexp_replace(control_id, '(?i)^CIS\\s*', ''))]
        when framework = 'PCI DSS' then [trim(regexp_replace(control_id, '(?i)^Req\\.?\\s*', '')), 'Req.' || trim(regexp_replace(control_id, '(?i)^Req\\.?\\s*', ''))] else cast([] as varchar[]) end as v from (select distinct control_id, framework from cited)""",
    "variants1": "select control_id, framework, unnest(v) as variant, generate_subscripts(v, 1) as i from variants0",
    "variants": "select control_id, framework, variant, cast(row_number() over (partition by control_id, framework order by min(i)) - 1 as integer) as variant_ord from variants1 where variant <> '' group by control_id, framework, variant",
    "reverse": "select v.control_id, v.framework, x.scf_id, x.ord, variant_ord, min(variant_ord) over (partition by v.control_id, v.framework) as best from variants v join c_scf_crosswalk x on x.framework = v.framework and x.control_id = v.variant",
    "to_scf": "select control_id, framework, scf_id, ord from reverse where variant_ord = best",
    "few": "select domain, control_id as scf_id, row_number() over (partition by domain order by ord) as nth from c_scf",
    "found_scf": f"""select {_K}, scf_id, min(place) as place from (select {_K}, c.control_id as scf_id, k * 1000 as place from cited c where c.control_id in (select control_id from c_scf)
        union all select {_K}, scf_id, k * 1000 + ord from cited join to_scf using (control_id, framework) union all select t.doc_id, t.version_ord, t.statement_id, t.stmt_ord, scf_id, k * 1000 + nth from topics t join few using (domain) join statements s using ({_K}) where nth <= 6 and len(s.framework_ids) = 0) group by all""",
    "chosen": f"select * from (select {_K}, scf_id, confidence as own, len(framework_ids) > 0 as is_cited, row_number() over (partition by {_K} order by place, scf_id) as nth from found_scf join statements using ({_K})) where nth <= 12",
    "cross0": f"select *, {_TARGET} as target, row_number() over (partition by scf_id, framework order by ord) as in_fw from c_scf_crosswalk",
    "cross1": "select *, row_number() over (partition by scf_id order by target, in_fw) as turn from cross0 where in_fw <= 4 and target is not null",
    "h_scf": f"""select {_K}, 'scf' as source, nth as hit_ord, 'SCF' as framework, scf_id as control_id, coalesce(title, '') as title, 'backbone' as relationship, least(case when is_cited then 0.9 else 0.72 end::double, case when own > 0 then own else 1 end) as confidence from chosen left join (select control_id as scf_id, title from c_scf) using (scf_id)
        union all select {_K}, 'scf', n_out + 100, framework, control_id, '', 'scf-crosswalk', least(0.88::double, case when own > 0 then own else 1 end) from (select *, row_number() over (partition by {_K} order by turn, nth) as n_out from chosen join cross1 using (scf_id)) where n_out <= 24""",
    "ksi_control": f"select distinct {_K}, ksi_id, ord from (select {_K}, upper(regexp_replace(control_id, '[.(]\\d+\\)?$', '')) as base from cited where regexp_matches(control_id, '^[A-Z]{{2}}-\\d+')) join (select *, upper(regexp_replace(control, '[.(]\\d+\\)?$', '')) as base from c_ksi) using (base)",
    "ksi_topic": f"select distinct {_K}, ksi_id, k.ord from statements s join c_ksi_words w on contains(lower(s.text), w.word) join c_ksi k on string_split(k.ksi_id, '-')[2] = w.grp",
    "h_ksi": f"select {_K}, 'ksi' as source, case when c > 0.6 then ord else ord + 1000 end as hit_ord, 'FedRAMP KSI' as framework, ksi_id as control_id, '' as title, 'map' as relationship, c as confidence from (select {_K}, ksi_id, ord, max(c) as c from (select *, 0.9::double as c from ksi_control union all select *, 0.55::double from ksi_topic) group by all)",
    "hits": f"select {', '.join(_COL)}, confidence from (select *, row_number() over (partition by {_K}, source, framework, control_id order by hit_ord) as nth from (select * from h_scf union all select * from h_seed union all select * from h_cited union all select * from h_ksi) where control_id <> '') where nth = 1",
}


def _hit_rows(h: DataFrame) -> DataFrame:
    return h.select(*_COL, F.round("confidence", 4).alias("confidence"))


def hits(s: SparkSession, d: str) -> DataFrame:
    return built(s, d, "hits", *crosswalk.hit_parts(statements(s, d), *(catalog(s, n) for n in ("scf", "scf_crosswalk", "seed", "ksi", "ksi_words"))))


def _cited(s: SparkSession, d: str) -> DataFrame:
    return statements(s, d).select(F.explode("framework_ids").alias("control_id")).distinct().withColumn("framework", F.expr(rules.framework(SPARK, "control_id")))


register("seed_hits", lambda s, d: _hit_rows(crosswalk.seed_hits(statements(s, d), catalog(s, "seed"))), f"select {_H} from h_seed", HITS)
register("explicit_hits", lambda s, d: _hit_rows(crosswalk.explicit_hits(statements(s, d))), f"select {_H} from h_cited", HITS)
register("explicit_titles", lambda s, d: _hit_rows(crosswalk.explicit_hits(statements(s, d), catalog(s, "seed").filter("framework = 'NIST 800-53'").select("control_id", "title").distinct())), f"select {_H} from (select h.* exclude (title), coalesce(case when h.framework = 'NIST 800-53' then t.title end, '') as title from h_cited h left join (select distinct control_id, title from c_seed where framework = 'NIST 800-53') t on t.control_id = h.control_id)", HITS)
register("ksi_for_class", lambda s, d: _hit_rows(crosswalk.ksi_hits(statements(s, d), catalog(s, "ksi"), catalog(s, "ksi_words"), "b")), f"select {_H} from h_ksi", HITS | {"c_ksi": f"select * from ({catalog_sql('ksi')}) k where b <> 'not_applicable'"})
register("guess_framework", lambda s, d: _cited(s, d), "select distinct control_id, framework from cited", HITS)
register("normalize_nist_id", lambda s, d: _cited(s, d).select("control_id", F.expr(crosswalk.normalize_nist_id("control_id")).alias("padded")), f"select distinct control_id, {_NIST.format(c='control_id')} as padded from cited", HITS)
register("lookup_key_variants", lambda s, d: crosswalk.lookup_key_variants(_cited(s, d)), "select control_id, framework, variant_ord, variant from variants", HITS)
register("framework_to_scf", lambda s, d: crosswalk.framework_to_scf(_cited(s, d), catalog(s, "scf_crosswalk")), "select control_id, framework, scf_id, ord from to_scf", HITS)
register("domain_fallback", lambda s, d: crosswalk.scf_ids(statements(s, d), catalog(s, "scf"), catalog(s, "scf_crosswalk")), "select doc_id, version_ord, statement_id, stmt_ord, scf_id, cast(place as bigint) as place from found_scf", HITS)
register("scf_expand", lambda s, d: _hit_rows(crosswalk.scf_hits(statements(s, d), catalog(s, "scf"), catalog(s, "scf_crosswalk"))), f"select {_H} from h_scf", HITS)
register("ksi_by_control", lambda s, d: crosswalk.ksi_by_control(statements(s, d), catalog(s, "ksi")), f"select {_K}, ksi_id, ord from ksi_control", HITS)
register("ksi_by_topic", lambda s, d: crosswalk.ksi_by_topic(statements(s, d), catalog(s, "ksi"), catalog(s, "ksi_words")), f"select {_K}, ksi_id, ord from ksi_topic", HITS)
register("ksi_map_statement", lambda s, d: _hit_rows(crosswalk.ksi_hits(statements(s, d), catalog(s, "ksi"), catalog(s, "ksi_words"))), f"select {_H} from h_ksi", HITS)
register("map_statements", lambda s, d: _hit_rows(hits(s, d)), f"select {_H} from hits", HITS)

# --- coverage --------------------------------------------------------------
register("coverage_matrix", lambda s, d: coverage.coverage_matrix(hits(s, d)).select("doc_id", "version_ord", "framework", F.array_join("controls", ",").alias("controls")), "select doc_id, version_ord, framework, array_to_string(list_sort(list_distinct(list(control_id))), ',') as controls from hits group by all", HITS)
register("coverage_gaps", lambda s, d: coverage.coverage_gaps(policies(s, d), hits(s, d).filter("source = 'explicit-citation'")), f"select p.doc_id, p.version_ord, framework from pol p cross join (select unnest([{', '.join(repr(f) for f in coverage.EXPECTED)}]) as framework) f where not exists (select 1 from hits h where h.doc_id = p.doc_id and h.version_ord = p.version_ord and h.framework = f.framework and h.source = 'explicit-citation')", HITS)
register("blast_radius", lambda s, d: coverage.blast_radius(hits(s, d)), "select doc_id, version_ord, framework, control_id, title, statement_id, source from hits", HITS)
register("framework_rollup", lambda s, d: coverage.framework_rollup(hits(s, d)), "select framework, count(distinct control_id) as control_count, count(distinct statement_id) as statement_count, array_to_string(list_sort(list_distinct(list(control_id))), ';') as control_ids from hits group by all", HITS)
register("control_rollup", lambda s, d: coverage.control_rollup(hits(s, d), statements(s, d)), """select framework, control_id, title, sources, max_confidence, statement_count, doc_id, statement_ids, strengths, statement_kinds, classifier_confidences, obligations
    from (select framework, control_id, coalesce(arg_min(title, (doc_id, version_ord, stmt_ord, source, hit_ord)) filter (where title <> ''), '') as title, array_to_string(list_sort(list_distinct(list(source))), ';') as sources, printf('%.3f', max(confidence)) as max_confidence, count(distinct statement_id) as statement_count from hits group by all)
    join (select framework, control_id, doc_id, string_agg(statement_id, ';' order by version_ord, stmt_ord) as statement_ids, string_agg(strength, ';' order by version_ord, stmt_ord) as strengths, string_agg(statement_kind, ';' order by version_ord, stmt_ord) as statement_kinds, string_agg(printf('%.2f', confidence), ';' order by version_ord, stmt_ord) as classifier_confidences, string_agg(text, ' | ' order by version_ord, stmt_ord) as obligations
    from (select *, row_number() over (partition by framework, control_id, doc_id, statement_id order by version_ord, stmt_ord) as seen from (select distinct framework, control_id, doc_id, version_ord, stmt_ord, statement_id from hits)) join statements using (doc_id, version_ord, stmt_ord, statement_id) where seen = 1 group by framework, control_id, doc_id) using (framework, control_id)""", HITS)
_STALE = " union all ".join(f"select doc_id, version_ord, statement_id, '{i}' as issue, '{a}' as recommendation from statements where " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) for ws, i, a in coverage.STALE)
register("stale_refs", lambda s, d: coverage.stale_refs(statements(s, d)), _STALE)
register("evidence_packet", lambda s, d: coverage.evidence_packet(statements(s, d), hits(s, d), "AC-2"), """select s.doc_id, s.version_ord, s.statement_id, s.text, s.strength, coalesce(n, 0) as related, coalesce(own, first_, '') as mappings from statements s left join (select doc_id, version_ord, statement_id, nullif(count(*) filter (where meets), 0) as n, string_agg(label, ', ' order by nth) filter (where meets) as own, string_agg(label, ', ' order by nth) filter (where nth <= 3) as first_
    from (select *, framework || ':' || control_id as label, contains(upper(replace(control_id, ' ', '')), 'AC-2') as meets, row_number() over (partition by doc_id, version_ord, statement_id order by source, hit_ord, framework, control_id) as nth from hits) group by all) r using (doc_id, version_ord, statement_id) where n is not null or contains(array_to_string(framework_ids, ' '), 'AC-2')""", HITS)
register("control_graph_nodes", lambda s, d: coverage.control_graph(statements(s, d), hits(s, d))[0], """select id, kind, arg_max(label, place) as label from (select 'doc:' || doc_id as id, 'document' as kind, cast(doc_id as varchar) as label, (doc_id, version_ord, stmt_ord, '', 0) as place from statements union all select statement_id, 'statement', text[1:80], (doc_id, version_ord, stmt_ord, '', 0) from statements
    union all select 'control:' || framework || ':' || control_id, 'control', trim(control_id || ' ' || title), (doc_id, version_ord, stmt_ord, source, hit_ord) from hits) group by id, kind""", HITS)
register("control_graph_edges", lambda s, d: coverage.control_graph(statements(s, d), hits(s, d))[1], "select distinct src, dst, kind from (select 'doc:' || doc_id as src, statement_id as dst, 'contains' as kind from statements union all select statement_id, 'control:' || framework || ':' || control_id, relationship from hits)", HITS)


def _questions(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("question_id"), F.concat_ws(" ", F.lit("How do you review"), F.expr("element_at(array('privileged access', 'vendor contracts', 'backup media', 'incident logs', 'network boundary'), cast(event_id % 5 as int) + 1)"), "event_type").alias("text"))


# --- lineage ---------------------------------------------------------------
_SNAP = {
    "snap0": "select doc_id, version_ord, 'v' || version_ord as version_label, sha256(markdown) as markdown_hash from pol",
    "snaps": "select *, lag(snapshot_id) over (partition by doc_id order by version_ord) as parent_snapshot_id from (select *, substr(sha256('pol-' || doc_id || ':' || markdown_hash || ':' || version_label), 1, 20) as snapshot_id from snap0)",
    "diff": "select a.doc_id, 1 as older, 2 as newer, a.* exclude (doc_id), 'removed' as change from statements a where version_ord = 1 and not exists (select 1 from statements b where b.doc_id = a.doc_id and b.version_ord = 2 and b.content_hash = a.content_hash) union all select a.doc_id, 1, 2, a.* exclude (doc_id), 'added' from statements a where version_ord = 2 and not exists (select 1 from statements b where b.doc_id = a.doc_id and b.version_ord = 1 and b.content_hash = a.content_hash)",
    "cites": "select distinct doc_id, version_ord, unnest(framework_ids) as subject from statements",
}
register("commit_snapshots", lambda s, d: lineage.commit_snapshots(policies(s, d)).fillna({"parent_snapshot_id": ""}), "select doc_id, version_ord, version_label, markdown_hash, snapshot_id, coalesce(parent_snapshot_id, '') as parent_snapshot_id from snaps", _SNAP)
register("head", lambda s, d: lineage.head(lineage.commit_snapshots(policies(s, d))), "select doc_id, arg_max(snapshot_id, version_ord) as snapshot_id from snaps group by doc_id", _SNAP)
register("history", lambda s, d: lineage.history(lineage.commit_snapshots(policies(s, d))), "select doc_id, snapshot_id, row_number() over (partition by doc_id order by version_ord desc) - 1 as depth from snaps", _SNAP)
def _branched(s: SparkSession, d: str) -> DataFrame:
    """Policies with a third version of every fourth one that branches off the first, and the second version once more."""
    docs = policies(s, d).withColumn("base_version", F.lit(None).cast("int"))
    branch = docs.filter("version_ord = 1 and doc_id % 4 = 0").withColumns({"version_ord": F.lit(3), "base_version": F.lit(1), "markdown": F.concat("markdown", F.lit("\nBranches must be reviewed."))})
    return docs.unionByName(branch).unionByName(docs.filter("version_ord = 2"))


def _store(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """First versions committed before, all others now: the whole store."""
    def make(name: str) -> DataFrame:
        first = lineage.commit(_branched(s, d).filter("version_ord = 1"))
        return first[name].unionByName(lineage.commit(_branched(s, d), first)[name])

    return {name: built(s, d, f"store_{name}", lambda name=name: make(name)) for name in ("blobs", "snapshots")}


_BRANCHED = _SNAP | {
    "forked": "select doc_id, 3 as version_ord, 'v3' as version_label, sha256(markdown || chr(10) || 'Branches must be reviewed.') as markdown_hash, substr(sha256('pol-' || doc_id || ':' || sha256(markdown || chr(10) || 'Branches must be reviewed.') || ':v3'), 1, 20) as snapshot_id, (select snapshot_id from snaps s where s.doc_id = p.doc_id and s.version_ord = 1) as parent_snapshot_id from pol p where version_ord = 1 and doc_id % 4 = 0",
    "store_": "select doc_id, version_ord, version_label, markdown_hash, snapshot_id, parent_snapshot_id from snaps union all select * from forked",
}
register("commit_store", lambda s, d: _store(s, d)["snapshots"].fillna({"parent_snapshot_id": ""}), "select doc_id, version_ord, version_label, markdown_hash, snapshot_id, coalesce(parent_snapshot_id, '') as parent_snapshot_id from store_", _BRANCHED)
register("commit_blobs", lambda s, d: _store(s, d)["blobs"].select("markdown_hash", F.length("markdown").cast("long").alias("size")), "select distinct markdown_hash, length(markdown) as size from (select sha256(markdown) as markdown_hash, markdown from pol union all select sha256(m), m from (select markdown || chr(10) || 'Branches must be reviewed.' as m from pol where version_ord = 1 and doc_id % 4 = 0))", _BRANCHED)
register("branch_history", lambda s, d: lineage.history(_store(s, d)["snapshots"]), "select doc_id, snapshot_id, depth from (select doc_id, snapshot_id, 0::bigint as depth from (select *, row_number() over (partition by doc_id order by version_ord desc) as nth from store_) where nth = 1 union all select h.doc_id, h.parent_snapshot_id, 1 from (select *, row_number() over (partition by doc_id order by version_ord desc) as nth from store_) h where nth = 1 and h.parent_snapshot_id is not null)", _BRANCHED)
register("statement_diff", lambda s, d: lineage.statement_diff(statements(s, d), policies(s, d)).select("doc_id", "older", "newer", "content_hash", "statement_id", "text", "strength", "change"), "select doc_id, older, newer, content_hash, statement_id, text, strength, change from diff", _SNAP)
register("drift", lambda s, d: lineage.drift(statements(s, d), policies(s, d)), "select doc_id, older, newer, case when change = 'removed' then 'obligation_removed' else 'obligation_added' end as kind, statement_id as subject, case when change = 'added' then 'info' when strength in ('must', 'shall', 'prohibited') then 'high' else 'medium' end as severity from diff union all select doc_id, 1, 2, 'framework_citation_lost', subject, 'high' from cites a where version_ord = 1 and not exists (select 1 from cites b where b.doc_id = a.doc_id and b.version_ord = 2 and b.subject = a.subject)", _SNAP)


# --- impact ----------------------------------------------------------------
_V = lambda c: f"{rules.verbs(DUCK, c)}"
_CHANGE = _SNAP | {
    "reworded": rewordings_sql(),
    "reworded1": f"select *, {rules.verbs(DUCK, 'before')} as va, {rules.verbs(DUCK, 'after')} as vb, {rules.control_ids(DUCK, 'before')} as ia, {rules.control_ids(DUCK, 'after')} as ib from reworded",
    "reworded2": f"select *, {rules.classify(DUCK, 'before', 'va', 'ia')['strength']} as before_strength, {rules.classify(DUCK, 'after', 'vb', 'ib')['strength']} as after_strength, {rules.polarity(DUCK, 'before', 'va')} as before_polarity, {rules.polarity(DUCK, 'after', 'vb')} as after_polarity from reworded1",
    "reworded3": f"select *, {', '.join(f'{v} as {k}' for k, v in change_rules.change_features(DUCK, 'before', 'after').items())} from reworded2",
    "changed": f"select *, {change_rules.change_risk('change_kind', 'before_strength', 'sla')} as risk, {change_rules.change_note(DUCK, 'change_kind', 'before', 'after')} as note from (select *, {change_rules.change_kind(DUCK, 'before', 'after')} as change_kind from reworded3)",
}


def _changes(s: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        full = lineage.statement_diff(statements(s, d), policies(s, d))
        extra = statements(s, d).select("doc_id", "statement_id", "keywords", "heading_path").dropDuplicates(["doc_id", "statement_id"])
        return impact.verbiage_changes(full.join(extra.hint("merge"), ["doc_id", "statement_id"]))

    return built(s, d, "changes", make)


def _told(s: SparkSession, d: str) -> DataFrame:
    """The rewordings as changes of a statement of each policy."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("stmt_ord"))
    own = statements(s, d).filter("version_ord = 1").select("doc_id", "statement_id", "stmt_ord").withColumn("nth", nth).filter("nth = 1 + doc_id % 3")
    return built(s, d, "told", lambda: impact.change_kinds(rewordings(s, d)).join(own.hint("merge"), "doc_id").select("doc_id", F.lit(1).alias("older"), F.lit(2).alias("newer"), F.col("statement_id").alias("before_id"), F.lit("").alias("after_id"), "before", "after", "before_strength", "change_kind", "sla", "risk", "note"))


def _lost(s: SparkSession, d: str) -> DataFrame:
    return lineage.lost_citations(statements(s, d), policies(s, d)).withColumn("framework", F.expr(rules.framework(SPARK, "subject")))


def _touched_hits(s: SparkSession, d: str, name: str, changes: DataFrame) -> DataFrame:
    """Hits of the statements that changes touch: all that impacts read, a small part of all hits."""
    own = built(s, d, f"{name}_touched", lambda: impact.touched(statements(s, d), changes))
    return built(s, d, f"{name}_hits", *crosswalk.hit_parts(own, *(catalog(s, n) for n in ("scf", "scf_crosswalk", "seed", "ksi", "ksi_words"))))


def _told_impacts(s: SparkSession, d: str) -> DataFrame:
    return built(s, d, "told_impacts", lambda: impact.framework_impacts(_told(s, d), _touched_hits(s, d, "told", _told(s, d)), _lost(s, d)))


def _told_risks(s: SparkSession, d: str) -> impact.AtRisk:
    return impact.risk_classes(_told_impacts(s, d), infra.assessments(s, d))


def _impacts(s: SparkSession, d: str) -> DataFrame:
    return built(s, d, "impacts", lambda: impact.framework_impacts(_changes(s, d), _touched_hits(s, d, "changed", _changes(s, d)), _lost(s, d)))


def _due(s: SparkSession, d: str) -> DataFrame:
    return registry.documentation_actions(registry.active_assessments(infra.assessments(s, d)), infra.assessments(s, d), registry.doc_musts(_duties(s, d)), catalog(s, "cadences"))


register("change_kind", lambda s, d: impact.change_kinds(rewordings(s, d)).select("doc_id", "before", "after", "before_strength", "after_strength", "before_polarity", "after_polarity", "change_kind"), "select doc_id, before, after, before_strength, after_strength, before_polarity, after_polarity, change_kind from changed", _CHANGE)
register("sla_delta", lambda s, d: impact.change_kinds(rewordings(s, d)).select("doc_id", "sla"), "select doc_id, sla from changed", _CHANGE)
register("quantitative_delta", lambda s, d: rewordings(s, d).select("doc_id", F.expr(change_rules.quantitative_delta(SPARK, "before", "after")).alias("delta")), f"select doc_id, {change_rules.quantitative_delta(DUCK, 'before', 'after')} as delta from reworded", _CHANGE)
register("exception_markers", lambda s, d: rewordings(s, d).select("doc_id", F.expr(f"array_join({change_rules.exceptions(SPARK, 'after')}, ',')").alias("markers")), f"select doc_id, array_to_string({change_rules.exceptions(DUCK, 'after')}, ',') as markers from reworded", _CHANGE)
register("change_risk", lambda s, d: impact.change_kinds(rewordings(s, d)).select("doc_id", "risk"), "select doc_id, risk from changed", _CHANGE)
register("change_note", lambda s, d: impact.change_kinds(rewordings(s, d)).select("doc_id", "note"), "select doc_id, note from changed", _CHANGE)
register("heading_scope", lambda s, d: impact.change_kinds(rewordings(s, d)).filter("before_heading <> after_heading").groupBy("before_heading", "after_heading", "change_kind").agg(F.count("*").alias("n")), "select before_heading, after_heading, change_kind, count(*) as n from changed where before_heading <> after_heading group by all", _CHANGE)
_RANK, _NAME_OF = change_rules.severity_rank, change_rules.severity_name
_TOLD = HITS | _CHANGE | {
    "told": "select doc_id, statement_id, change_kind, risk, note from changed join (select doc_id, statement_id, row_number() over (partition by doc_id order by stmt_ord) as nth from statements where version_ord = 1) using (doc_id) where nth = 1 + doc_id % 3",
    "touched": f"""select doc_id, framework, control_id, {_RANK('risk')} as r, note, statement_id from told join (select distinct doc_id, statement_id, framework, control_id from hits) using (doc_id, statement_id) where change_kind in ({', '.join(repr(k) for k in impact.RISKY)})
        union all select doc_id, {rules.framework(DUCK, 'subject')}, subject, 3, 'Citation ' || subject || ' is gone from the document.', null from cites a where version_ord = 1 and not exists (select 1 from cites b where b.doc_id = a.doc_id and b.version_ord = 2 and b.subject = a.subject)""",
    "reached_fw": "select doc_id, framework, max(r) as r, string_agg(distinct control_id, ',' order by control_id) as controls, count(distinct statement_id) as changes, array_to_string(list_transform(list_sort(list_distinct(list({'r': -r, 'note': note})))[1:3], lambda x: x.note), '; ') as reasons from touched group by all",
    "asm": infra.assessments_sql(),
    "widened": """select doc_id, framework, r from reached_fw union all select doc_id, 'FedRAMP KSI', r from reached_fw a where framework = 'NIST 800-53' and not exists (select 1 from reached_fw b where b.doc_id = a.doc_id and b.framework = 'FedRAMP KSI')
        union all select doc_id, 'FedRAMP', case when exists (select 1 from reached_fw b where b.doc_id = a.doc_id and b.framework = 'FedRAMP KSI') then 2 else r end from reached_fw a where framework = 'NIST 800-53'""",
    "endangered": "select doc_id, assessment_id, max(r) as r, string_agg(distinct framework, ',' order by framework) as frameworks from widened join (select assessment_id, doc_ids, unnest(frameworks) as framework from asm where status = 'active') using (framework) where len(doc_ids) = 0 or list_contains(doc_ids, doc_id) group by all",
    "rolled": f"select doc_id, cast(sum(n) as bigint) as changes, {_NAME_OF('max(r)')} as severity from (select doc_id, case when change_kind = 'obligation_added' then 0 else {_RANK('risk')} end as r, 1 as n from told union all select doc_id, r, 0 from reached_fw union all select doc_id, r, 0 from endangered) group by doc_id",
}
register("severity_rollup", lambda s, d: impact.severity_rollup(_told(s, d), _told_impacts(s, d), _told_risks(s, d)), "select doc_id, 1 as older, 2 as newer, changes, severity from rolled", _TOLD)
register("reworded_impacts", _told_impacts, f"select doc_id, 1 as older, 2 as newer, framework, controls, changes, reasons, {_NAME_OF('r')} as risk from reached_fw", _TOLD)
register("assessments_at_risk", lambda s, d: impact.assessments_at_risk(_told_impacts(s, d), infra.assessments(s, d)), f"select doc_id, 1 as older, 2 as newer, assessment_id, frameworks, {_NAME_OF('r')} as risk from endangered", _TOLD)
_ALERTS = _TOLD | {f"c_{n}": catalog_sql(n) for n in ("duties", "cadences")} | {
    "by_class": "select req_id, name, statement, class_id, force from (unpivot (select * exclude (ord) from c_duties) on a, b, c, d into name class_id value force)",
    "matrix": "select req_id, name, class_id, case when force <> '' then force else 'APPLICABLE' end as force from by_class where force <> '' or statement <> ''",
    "musts": "select class_id, array_to_string(list_sort(list(req_id || ' (' || name || ')'))[1:4], ', ') as documents from matrix where force = 'MUST' group by class_id",
    "due": "select assessment_id, class_id, documents, coalesce(number || ' ' || unit, '') as cadence from asm join musts using (class_id) left join c_cadences using (class_id) where status = 'active'",
    "kept": "select doc_id, max(class_id) as class_id, list_sort(list_distinct(list('Keep the documents of class ' || upper(class_id) || ' up to date: ' || documents || case when cadence <> '' then '; package every ' || cadence else '' end || '.'))) as keep from endangered join due using (assessment_id) group by doc_id",
    "listed": f"select doc_id, count(*) filter (where change_kind <> 'obligation_added') as risked, bool_or(change_kind in ({', '.join(repr(k) for k in impact.BLOCKING)})) as blocking from told group by doc_id",
    "fws": "select doc_id, list_sort(list_distinct(list(framework))) as f from reached_fw group by doc_id",
    "asms": "select doc_id, list_sort(list_distinct(list(assessment_id))) as a from endangered group by doc_id",
}
_SAYS = [f"'{a}'" for a in impact.ACTIONS]
register("reworded_alerts", lambda s, d: impact.impact_alerts(_told(s, d), _told_impacts(s, d), _told_risks(s, d), _due(s, d)).withColumn("actions", F.array_join("actions", " | ")),
    f"""select doc_id, 1 as older, 2 as newer, changes, severity, substr(sha256('pol-' || doc_id || ':1:2:' || severity), 1, 16) as alert_id, '[' || upper(severity) || '] pol-' || doc_id || ': ' || coalesce(risked, 0) || ' duties changed; frameworks: ' || coalesce(array_to_string(f[1:4], ', '), 'none') || '; assessments: ' || coalesce(array_to_string(a[1:3], ', '), 'none') as summary,
        array_to_string(list_concat(list_filter([{_SAYS[0]}, {_SAYS[1]}, case when blocking then {_SAYS[2]} end, case when f is not null then 'Check coverage again: ' || array_to_string(f, ', ') end, case when a is not null then 'Tell the owners of: ' || array_to_string(a, ', ') end], lambda x: x is not null), coalesce(keep, [])), ' | ') as actions, coalesce(class_id, '') as class_id
        from rolled left join listed using (doc_id) left join fws using (doc_id) left join asms using (doc_id) left join kept using (doc_id)""", _ALERTS)  # fmt: skip
register("verbiage_changes", lambda s, d: _changes(s, d))
register("framework_impacts", _impacts)


def _alerts(s: SparkSession, d: str) -> DataFrame:
    return impact.impact_alerts(_changes(s, d), _impacts(s, d), impact.risk_classes(_impacts(s, d), infra.assessments(s, d)), _due(s, d))


register("impact_alert", lambda s, d: _alerts(s, d).withColumn("actions", F.array_join("actions", " | ")))


# --- infrastructure, reconciliation ----------------------------------------
def _resources(s: SparkSession, d: str) -> DataFrame:
    """Resources of both revisions, parsed from files and classified."""
    return built(s, d, "resources", lambda: iac.iac_classify(iac.iac_extract(infra.files(s, d))))


_LISTED = "list_filter(list_transform(string_split_regex({}, '[,|]'), lambda x: trim(x)), lambda x: x <> '')"
_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
_TERMS = [(k, r[0], side, t.replace(" ", "")) for k, r in enumerate(iac_rules.RULES) for side, terms in (("type", r[1]), ("text", r[2])) for t in terms]
_SETS = [(k, what, v) for k, r in enumerate(iac_rules.RULES) for what, values in (("control", r[3]), ("role", r[4])) for v in values]
_KNOWN = "[" + ", ".join(f"'{x}'" for x in rules.DOMAIN_WORDS) + "]"
_BELOW = "len(list_filter(paths, lambda p: contains(relative_path, p) or ends_with(p, relative_path))) > 0"
_REF = "repository || '::' || module_path || '::' || address"
_G = "link_id, doc_id, kind, severity, iac_ref"
_GAPS = "link_id, coalesce(doc_id, -1) as doc_id, kind, severity, iac_ref"
_shown = lambda q: lambda s, d: q(s, d).fillna({"doc_id": -1})
_INFRA = _SNAP | {
    "res": f"select *, sha256(block) as content_hash, replace(block, {infra.HEREDOC}, '') as code from (select *, {infra.BLOCK} as block from ({infra.resources_sql()}) q) r",
    "files_": infra.files_sql("select * exclude (block, code) from res").replace("{agg}", "string_agg(block, chr(10) order by p_partkey)"),
    "lnk": infra.links_sql(),
    "asm": infra.assessments_sql(),
    "terms": f"select * from (values {_VALUES(_TERMS)}) t(rule, domain, side, term)",
    "sets": f"select * from (values {_VALUES(_SETS)}) t(rule, what, value)",
    "term_hits": "select p_partkey, revision, rule, domain, bool_or(side = 'type') as by_type, bool_or(side = 'text') as by_text from res join terms on (side = 'type' and contains(lower(resource_type), term)) or (side = 'text' and contains(replace(lower(code), ' ', ''), term)) group by all",
    "by_rule": "select p_partkey, revision, list(domain) as rd, bool_or(by_type) as t, bool_or(by_text) as x, bool_or(by_type and by_text) as tx from term_hits group by all",
    "by_value": "select p_partkey, revision, coalesce(list(value) filter (where what = 'control'), []) as rc, coalesce(list(value) filter (where what = 'role'), []) as rr from term_hits join sets using (rule) group by all",
    "judged": f"""select r.*, coalesce(rd, []) as rd, coalesce(rc, []) as rc, coalesce(rr, []) as rr, coalesce(t, false) as t, coalesce(x, false) as x, coalesce(tx, false) as tx, {_LISTED.format('r.control_ids')} as dc, list_transform({_LISTED.format('r.domains')}, lambda d: {rules.normal_domain(DUCK, 'd')}) as dd,
        list_transform({_LISTED.format('r.roles')}, lambda q: lower(q)) as dr, contains(code, '0.0.0.0/0') as open_, regexp_matches(code, '{iac_rules.DISABLED}') as off_ from res r left join by_rule using (p_partkey, revision) left join by_value using (p_partkey, revision)""",
    "judged1": f"""select *, list_filter(dc, lambda c: regexp_matches(c, '{iac_rules.CONTROL_ID}')) as good, list_filter(dc, lambda c: not regexp_matches(c, '{iac_rules.CONTROL_ID}')) as bad from judged""",
    "judged2": f"""select *, list_sort(list_distinct(list_concat(list_concat(rd, list_filter(dd, lambda d: list_contains({_KNOWN}, d))), case when open_ then ['network_security'] else [] end))) as all_domains, list_filter(dd, lambda d: not list_contains({_KNOWN}, d)) as unknown_domains,
        round(least(0.99, greatest(case when t then 0.82 else 0 end, case when x then 0.74 else 0 end, case when tx then 0.9 else 0 end, case when len(good) > 0 then 0.99 else 0 end, case when len(bad) > 0 then 0.5 else 0 end, case when len(dd) > 0 then 0.98 else 0 end, case when len(dr) > 0 then 0.98 else 0 end, case when link_id <> '' then 0.97 else 0 end, case when open_ or off_ then 0.92 else 0 end)), 2)::double as sure from judged1""",
    "judged3": "select *, len(all_domains) > 0 or len(dc) > 0 or link_id <> '' as sensitive, len(good) > 0 or len(dd) > 0 or len(dr) > 0 as reviewed from judged2",
    "judged4": "select *, case when off_ then 'violated' when len(bad) > 0 or (open_ and not (lower(posture) in ('approved', 'implemented') or exception_id <> '')) then 'review_required' when sensitive and (reviewed or sure >= 0.85) then 'implemented' else 'unknown' end as state from judged3",
    "classified": """select p_partkey, repository, revision, module_path, address, resource_type, relative_path, link_id, content_hash, all_domains, array_to_string(all_domains, ',') as domains, array_to_string(list_sort(list_distinct(list_concat(list_concat(rc, list_transform(good, lambda c: upper(c))), case when open_ then ['SC-7', 'AC-4'] else [] end))), ',') as control_ids,
        case when off_ then 'configuration_risk' else array_to_string(list_sort(list_distinct(list_concat(list_concat(rr, dr), case when open_ then ['preventive', 'exposure'] else [] end))), ',') end as roles, array_to_string(unknown_domains, ',') as unknown_domains, sensitive as security_sensitive, sure as confidence, state as posture,
        case when state = 'violated' then 'misconfigured' when state = 'review_required' then 'review_required' when reviewed then 'reviewed_annotation' when sensitive and sure >= 0.85 then 'classified' when sensitive then 'review_required' else 'not_security_relevant' end as status from judged4""",
    "delta": "select repository, module_path, address, case when a.content_hash is null then 'added' when b.content_hash is null then 'removed' else 'changed' end as change, coalesce(b.link_id, a.link_id) as link_id, coalesce(b.resource_type, a.resource_type) as resource_type from (select * from res where revision = 1) a full outer join (select * from res where revision = 2) b using (repository, module_path, address) where a.content_hash is null or b.content_hash is null or a.content_hash <> b.content_hash",
    "matched": "select link_id, doc_id, version_ord, statement_id, content_hash from (select l.link_id, l.doc_id, version_ord, statement_id, content_hash, row_number() over (partition by l.link_id, version_ord order by stmt_ord) as nth from lnk l join statements s using (doc_id) where contains(lower(s.text), lower(anchor)) or (len(l.keywords) > 0 and len(list_filter(l.keywords, lambda k: not contains(lower(s.text), k))) = 0)) where nth = 1",
    "wired": f"""select distinct link_id, repository, revision, module_path, address from (select l.link_id, l.repositories, r.* exclude (link_id) from lnk l join res r using (link_id)
        union all select n.link_id, n.repositories, r.* exclude (link_id) from (select *, unnest(addresses) as wanted from lnk) n join res r on r.address = wanted or r.module_path || '::' || r.address = wanted
        union all select n.link_id, n.repositories, r.* exclude (link_id) from (select *, unnest(types) as wanted from lnk where len(addresses) = 0) n join res r on r.resource_type = wanted where {_BELOW}) where len(repositories) = 0 or list_contains(repositories, repository)""",
    "doubtful": f"select link_id, revision, address, string_agg(distinct {_REF}, ', ' order by {_REF}) as iac_ref from wired join (select link_id, unnest(addresses) as address from lnk) using (link_id, address) group by all having count(*) > 1",
    "gaps_": f"""select link_id, doc_id, kind, case kind when 'covered' then 'info' when 'missing_policy_statement' then 'high' else 'critical' end as severity, case when kind = 'ambiguous_iac_selector' then coalesce(u, '') else '' end as iac_ref from (select l.link_id, l.doc_id, u, case when u is not null then 'ambiguous_iac_selector' when l.link_id not in (select link_id from matched where version_ord = 2) then 'missing_policy_statement'
        when l.link_id not in (select link_id from wired where revision = 2) then 'missing_iac_implementation' else 'covered' end as kind from lnk l left join (select link_id, min(iac_ref) as u from doubtful where revision = 2 group by all) using (link_id))
        union all select '', null, 'orphan_iac_annotation', 'medium', {_REF} from res where revision = 2 and link_id <> '' and link_id not in (select link_id from lnk)""",
    "reached": "select distinct link_id, repository, module_path, address from wired",
    "code_gaps": f"""select link_id, doc_id, 'iac_' || change || '_requires_doc_review' as kind, case when change = 'removed' then 'critical' else 'high' end as severity, address as iac_ref from (select * exclude (link_id) from delta) join reached using (repository, module_path, address) join lnk using (link_id)
        union all select '', null, 'unlinked_sensitive_iac_change', 'high', {_REF} from delta d where not exists (select 1 from reached r where r.repository = d.repository and r.module_path = d.module_path and r.address = d.address)
        and (regexp_matches(lower(resource_type), '{'|'.join(iac_rules.SENSITIVE_TYPES)}') or exists (select 1 from classified c where c.security_sensitive and c.repository = d.repository and c.module_path = d.module_path and c.address = d.address))
        union all select distinct link_id, doc_id, 'doc_anchor_missing_after_iac_change', 'critical', '' from (select * exclude (link_id) from delta) join reached using (repository, module_path, address) join lnk using (link_id) where link_id not in (select link_id from matched where version_ord = 2)""",
    "refs": f"select link_id, string_agg({_REF}, ', ' order by {_REF}) as refs from wired where revision = 2 group by link_id",
    "doc_gaps": """select link_id, doc_id, kind, case when contains(kind, 'removed') then 'critical' else 'high' end as severity, coalesce(refs, '') as iac_ref from (select l.link_id, l.doc_id, refs, case when o.content_hash is not null and n.content_hash is null then 'policy_obligation_removed_iac_still_present'
        when o.content_hash <> n.content_hash then 'policy_obligation_changed_verify_iac' when n.content_hash is not null and refs is null then 'policy_without_iac' end as kind
        from lnk l left join (select * from matched where version_ord = 1) o using (link_id) left join (select * from matched where version_ord = 2) n using (link_id) left join refs using (link_id)) where kind is not null""",
    "both_": f"""select link_id, max(doc_id) as doc_id, case when bool_or(contains(kind, 'removed')) then 'coordinated_control_retirement_review' else 'coordinated_policy_iac_change' end as kind, {change_rules.severity_name(f"max({change_rules.severity_rank('severity')})")} as severity, coalesce(string_agg(distinct iac_ref, ', ' order by iac_ref) filter (where iac_ref <> ''), '') as iac_ref
        from (select * from code_gaps union all select * from doc_gaps) where link_id <> '' and link_id in (select link_id from code_gaps) and link_id in (select link_id from doc_gaps) group by link_id""",
    "change_set_": f"select {_G} from code_gaps union all select {_G} from doc_gaps union all select {_G} from both_ union all select {_G} from gaps_ g where kind <> 'covered' and not exists (select 1 from (select * from code_gaps union all select * from doc_gaps union all select * from both_) h where h.kind = g.kind and h.link_id = g.link_id and h.iac_ref = g.iac_ref)",
    "want": f"select *, list_distinct(list_transform(expected_domains, lambda d: {rules.normal_domain(DUCK, 'd')})) as expected from lnk",
    "said": "select w.link_id, w.doc_id, w.expected, w.expected_kind, w.expected_strength, w.expected_polarity, s.keywords as policy_domains, statement_kind, strength, action_polarity, confidence from want w join matched m using (link_id, doc_id) join statements s using (doc_id, version_ord, statement_id) where len(expected) > 0 and version_ord = 2",
    "coded": f"select w.link_id, w.doc_id, expected, all_domains, posture, confidence, {_REF} as ref from want w join wired x using (link_id) join classified c using (repository, revision, module_path, address) where len(expected) > 0 and revision = 2",
    "per_link": "select link_id, doc_id, expected, list_distinct(flatten(list(all_domains))) as code_domains, string_agg(distinct ref, ', ' order by ref) as refs from coded group by all",
    "alignment": f"""select link_id, doc_id, 'classifier_ground_truth_missing' as kind, 'medium' as severity, '' as iac_ref from want where len(expected) = 0
        union all select link_id, doc_id, 'policy_classifier_review_required', 'medium', '' from said where confidence < 0.85
        union all select link_id, doc_id, 'policy_statement_semantic_mismatch', 'critical', '' from said where coalesce(expected_kind <> statement_kind, false) or coalesce(expected_strength <> strength, false) or coalesce(expected_polarity <> action_polarity, false)
        union all select link_id, doc_id, 'policy_classifier_domain_mismatch', 'high', '' from said where not list_has_all(policy_domains, expected)
        union all select link_id, doc_id, 'policy_classifier_unexpected_domain', 'high', '' from said where not list_has_all(expected, policy_domains)
        union all select link_id, doc_id, 'terraform_classifier_domain_mismatch', 'high', refs from per_link where not list_has_all(code_domains, expected)
        union all select link_id, doc_id, 'terraform_classifier_unexpected_domain', 'high', refs from per_link where not list_has_all(expected, code_domains)
        union all select link_id, doc_id, 'terraform_control_violation', 'critical', ref from coded where posture = 'violated'
        union all select link_id, doc_id, 'terraform_posture_review_required', 'medium', ref from coded where posture in ('unknown', 'review_required')
        union all select link_id, doc_id, 'terraform_classifier_review_required', 'medium', ref from coded where confidence < 0.85""",
    "runs_": infra.runs_sql(),
    "trans": "select *, case when status = 'aligned' and was in ('misaligned', 'review_required') then 'recovered' when status <> 'aligned' and (coalesce(before, '') = '' or coalesce(was, '') in ('', 'aligned')) then 'opened' when status <> 'aligned' and before <> finding then 'changed' when status <> 'aligned' then 'repeated' else 'unchanged' end as transition, status <> 'aligned' and coalesce(before = finding, false) as same from (select *, lag(status) over w as was, lag(finding) over w as before from runs_ window w as (partition by monitor_id order by run_ts, run_id))",
    "stretches": "select *, sum(case when same then 0 else 1 end) over (partition by monitor_id order by run_ts, run_id rows between unbounded preceding and current row) as stretch from trans",
}


def _parts(s: SparkSession, d: str, prefix: str, kind: type, names: tuple[str, ...], make: Callable[[], object]):
    """Tables that make up a ``kind``; planned only if they are not there yet, and then once."""
    whole = functools.cache(make)
    return kind(*(built(s, d, f"{prefix}_{name}", lambda name=name: getattr(whole(), name)) for name in names))


def _wired(s: SparkSession, d: str) -> reconcile.Wired:
    return _parts(s, d, "wired", reconcile.Wired, ("own", "members", "chosen"), lambda: reconcile.wired_resources(infra.links(s, d), _resources(s, d)))


def _matched(s: SparkSession, d: str) -> DataFrame:
    return built(s, d, "matched", lambda: reconcile.link_statement(infra.links(s, d), statements(s, d)))


def _now(t: DataFrame | reconcile.Wired) -> DataFrame | reconcile.Wired:
    if isinstance(t, reconcile.Wired):
        return t.where("revision = 2")
    return t.filter("revision = 2" if "revision" in t.columns else "version_ord = 2")


def _gaps(s: SparkSession, d: str) -> DataFrame:
    return built(s, d, "completeness", lambda: reconcile.completeness_gaps(infra.links(s, d), _now(_matched(s, d)), _now(_wired(s, d)), _now(_resources(s, d))))


def _code_gaps(s: SparkSession, d: str) -> reconcile.Gaps:
    return _parts(s, d, "code_gaps", reconcile.Gaps, ("rows", "shared", "members"), lambda: reconcile.code_gaps(iac.iac_diff(_resources(s, d), 1, 2), infra.links(s, d), _wired(s, d), _resources(s, d).filter("security_sensitive"), _now(_matched(s, d))))


def _doc_gaps(s: SparkSession, d: str) -> DataFrame:
    return built(s, d, "doc_gaps", lambda: reconcile.doc_change_gaps(infra.links(s, d), _matched(s, d).filter("version_ord = 1"), _now(_matched(s, d)), _now(_wired(s, d))))


def _alignment(s: SparkSession, d: str) -> DataFrame:
    return reconcile.alignment_gaps(infra.links(s, d), _now(_matched(s, d)), statements(s, d), _now(_wired(s, d)), _resources(s, d), exact=True)


def _change_set(s: SparkSession, d: str) -> reconcile.Gaps:
    return reconcile.change_set(_code_gaps(s, d), _doc_gaps(s, d), _gaps(s, d))


def _of_links(s: SparkSession, d: str) -> reconcile.Gaps:
    gaps = _change_set(s, d)
    return reconcile.Gaps(gaps.rows.filter("link_id <> ''"), gaps.shared, gaps.members)


_joined = lambda t, *cs: t.withColumns({c: F.array_join(c, ",") for c in cs})
_RC = ("repository", "revision", "module_path", "address")
_CL = (*_RC, "domains", "control_ids", "roles", "unknown_domains", "security_sensitive", "confidence", "posture", "status")
register("iac_extract", lambda s, d: _resources(s, d).select(*_RC, "resource_type", "link_id", "content_hash"), f"select {', '.join(_RC)}, resource_type, link_id, content_hash from res", _INFRA)
register("iac_annotations", lambda s, d: _resources(s, d).select(*_RC, F.explode("annotations").alias("key", "value")), "select repository, revision, module_path, address, key, value from (unpivot (select repository, revision, module_path, address, control_ids, domains, exception_id, link_id, posture, roles from res) on control_ids, domains, exception_id, link_id, posture, roles into name key value value) where value <> ''", _INFRA)
register("iac_tags", lambda s, d: _resources(s, d).select(*_RC, F.explode("tags").alias("key", "value")), "select repository, revision, module_path, address, 'grc_owner' as key, 'v' as value from res", _INFRA)
register("iac_classify", lambda s, d: _joined(_resources(s, d), "domains", "control_ids", "roles", "unknown_domains").select(*_CL), f"select {', '.join(_CL)} from classified", _INFRA)
register("control_id_valid", lambda s, d: _resources(s, d).select(F.explode(F.split(F.try_element_at("annotations", F.lit("control_ids")), "[,|]")).alias("control_id")).groupBy(F.trim("control_id").alias("control_id")).agg(F.count("*").alias("n")).select("control_id", "n", iac.control_id_valid(F.col("control_id")).alias("valid")), "select control_id, count(*) as n, control_id <> 'XX-9' as valid from (select unnest(dc) as control_id from judged) group by control_id", _INFRA)
register("iac_diff", lambda s, d: iac.iac_diff(_resources(s, d), 1, 2), "select repository, module_path, address, change, link_id, resource_type from delta", _INFRA)
register("identity_duplicates", lambda s, d: iac.identity_duplicates(_resources(s, d).union(_resources(s, d).filter("module_path like '%1'"))), "select repository, module_path, address, revision, 2::bigint as n from res where module_path like '%1'", _INFRA)
register("file_evidence", lambda s, d: iac.file_evidence(infra.files(s, d), _resources(s, d)), "select repository, revision, relative_path, sha256(content) as sha256, (select count(*) from res r where r.repository = f.repository and r.revision = f.revision and r.relative_path = f.relative_path) as n from files_ f", _INFRA)
register("unclassified_file_change", lambda s, d: iac.unclassified_file_change(infra.files(s, d), _resources(s, d), 1, 2),
    f"""select repository, relative_path, change, coalesce(moved, false) as mixed from (select repository, relative_path, case when a.content is null then 'added' when b.content is null then 'removed' else 'changed' end as change from (select * from files_ where revision = 1) a full outer join (select * from files_ where revision = 2) b using (repository, relative_path) where a.content is distinct from b.content)
        left join (select repository, relative_path, true as moved from (select *, count(*) over (partition by repository, module_path, address, content_hash) as n from res) where n = 1 group by all) using (repository, relative_path)
        left join (select * from beside where revision = 1) x using (repository, relative_path) left join (select * from beside where revision = 2) y using (repository, relative_path) where moved is null or x.outside is distinct from y.outside""",
    _INFRA | {"beside": f"select repository, revision, relative_path, {infra.HEAD} || string_agg({infra.note_sql()}, '' order by p_partkey) as outside from res group by repository, revision, relative_path"})
register("history_gaps", lambda s, d: iac.history_gaps(infra.links(s, d).select(F.col("link_id").alias("target"), F.concat(F.lit("infra-"), F.col("doc_id") % 5).alias("repository"), (F.col("doc_id") % 3 + 1).cast("int").alias("revision")), _resources(s, d)), "select link_id as target, 'infra-' || (doc_id % 5) as repository, cast(doc_id % 3 + 1 as integer) as revision, 'history_unavailable' as kind, 'high' as severity from lnk where doc_id % 5 > 2 or doc_id % 3 = 2", _INFRA)
_SEEN = lambda s, d, r, n: infra.files(s, d).filter(f"revision = {r}").select("repository", F.lit(0).alias("revision"), F.col("relative_path").alias("path"), F.sha2("content", 256).alias("digest"), F.endswith("relative_path", F.lit(n)).alias("is_link"))
register("unpinned_inputs", lambda s, d: iac.unpinned_inputs(_SEEN(s, d, 2, "11/main.tf"), _SEEN(s, d, 1, "nowhere")), "select repository, 0 as revision, relative_path as path, case when b.content is not null and ends_with(relative_path, '11/main.tf') then 'symlink' when b.content is null then 'missing' when a.content is null then 'untracked' else 'different' end as state from (select * from files_ where revision = 1) a full outer join (select * from files_ where revision = 2) b using (repository, relative_path) where a.content is distinct from b.content or ends_with(relative_path, '11/main.tf')", _INFRA)
register("link_statement", _matched, "select link_id, doc_id, version_ord, statement_id, content_hash from matched", _INFRA)
register("link_resources", lambda s, d: _wired(s, d).rows(), "select * from wired", _INFRA)
register("ambiguous_selector", lambda s, d: reconcile.ambiguous_selector(infra.links(s, d), _wired(s, d).own), "select * from doubtful", _INFRA)
register("link_violations", lambda s, d: registry.link_violations(infra.links(s, d).union(infra.links(s, d).filter("doc_id % 10 = 0"))), "select distinct link_id, unnest(list_filter([case when doc_id % 10 = 0 then 'link_id not unique' end, case when expected_kind is null then 'expected_kind missing' end, case when expected_strength is null then 'expected_strength missing' end, case when expected_polarity is null then 'expected_polarity missing' end], lambda x: x is not null)) as problem from lnk", _INFRA)
register("completeness_gaps", _shown(_gaps), f"select {_GAPS} from gaps_", _INFRA)
register("alignment_gaps", _shown(_alignment), f"select {_GAPS} from alignment", _INFRA)
register("unlinked_sensitive", lambda s, d: reconcile.unlinked_sensitive(_resources(s, d), _wired(s, d)), "select repository, revision, module_path, address, 'unlinked_security_sensitive_resource' as kind, case when confidence >= 0.85 then 'high' else 'medium' end as severity from classified c where security_sensitive and not exists (select 1 from wired w where w.repository = c.repository and w.revision = c.revision and w.module_path = c.module_path and w.address = c.address)", _INFRA)
register("iac_change_gaps", _shown(lambda s, d: _code_gaps(s, d).table()), f"select {_GAPS} from code_gaps", _INFRA)
register("doc_change_gaps", _shown(_doc_gaps), f"select {_GAPS} from doc_gaps", _INFRA)
register("change_set", _shown(lambda s, d: _change_set(s, d).table()), f"select {_GAPS} from change_set_", _INFRA)
register("gap_dedupe", _shown(lambda s, d: reconcile.gap_dedupe(_change_set(s, d).more(_gaps(s, d)))), f"select link_id, coalesce(max(doc_id), -1) as doc_id, kind, {change_rules.severity_name(f'max({change_rules.severity_rank("severity")})')} as severity, iac_ref from (select * from change_set_ union all select {_G} from gaps_) group by link_id, kind, iac_ref", _INFRA)
register("merge_target", lambda s, d: reconcile.merge_target(_of_links(s, d), "link_id"), f"select link_id, n, {change_rules.severity_name('r')} as severity, case when r >= 3 then 'misaligned' when r >= 1 then 'review_required' else 'aligned' end as status from (select link_id, count(*) as n, max({change_rules.severity_rank('severity')}) as r from change_set_ where link_id <> '' group by link_id)", _INFRA)
_MAPS = HITS | _INFRA
def _anchored(s: SparkSession, d: str) -> DataFrame:
    """Hits of the links' anchors and own controls; statement_id is the link's."""
    return built(s, d, "anchored", lambda: crosswalk.map_statements(reconcile.anchor_statements(infra.links(s, d)), *(catalog(s, n) for n in ("scf", "scf_crosswalk", "seed", "ksi", "ksi_words"))))


#: no anchor of this corpus holds a statement, so each stands for itself, with the link's controls
_ANCHORS = HITS | {"statements": f"select doc_id, 1 as version_ord, 1::bigint as stmt_ord, link_id as statement_id, anchor as text, cast([] as varchar[]) as keywords, control_ids as framework_ids, 0::double as confidence from ({infra.links_sql()}) l"}
register("link_scf_map", lambda s, d: reconcile.scf_map(_anchored(s, d).withColumnRenamed("statement_id", "link_id"), "link_id").withColumn("controls", F.array_join("controls", ",")), "select statement_id as link_id, framework, string_agg(distinct control_id, ',' order by control_id) as controls from hits group by all", _ANCHORS)
register("framework_labels", lambda s, d: reconcile.framework_labels(reconcile.scf_map(_now(_matched(s, d)).join(hits(s, d).hint("merge"), ["doc_id", "version_ord", "statement_id"]), "link_id"), "link_id"), "select distinct link_id, framework || ':' || control_id as label from matched join hits using (doc_id, version_ord, statement_id) where version_ord = 2", _MAPS)
register("mapping_assessments", lambda s, d: reconcile.mapping_assessments(_now(_matched(s, d)).join(hits(s, d).hint("merge"), ["doc_id", "version_ord", "statement_id"]), infra.assessments(s, d)), "select doc_id, assessment_id, string_agg(distinct framework, ',' order by framework) as frameworks from matched join hits using (doc_id, version_ord, statement_id) join (select *, unnest(frameworks) as framework from (select assessment_id, doc_ids, frameworks from asm where status = 'active')) using (framework) where version_ord = 2 and (len(doc_ids) = 0 or list_contains(doc_ids, doc_id)) group by doc_id, assessment_id".replace("select *, unnest(frameworks) as framework from", "select assessment_id, doc_ids, unnest(frameworks) as framework from"), _MAPS)
_SCF_OF = "select distinct repository, revision, module_path, address, control_id, 'NIST 800-53' as framework from (select *, unnest(string_split(control_ids, ',')) as control_id from classified where security_sensitive) where regexp_matches(control_id, '^(AC|AU|CA|CM|CP|IA|IR|MP|RA|SC|SI)-')"
register("resource_scf_map", lambda s, d: _resource_map(s, d), "select repository, revision, module_path, address, string_agg(distinct scf_id, ',' order by scf_id) as controls from declared_controls d join to_scf_all t using (control_id) group by all", _MAPS | {"declared_controls": _SCF_OF, "to_scf_all": f"select distinct control_id, scf_id from (select distinct control_id, {_NIST.format(c='control_id')} as padded from declared_controls) d join c_scf_crosswalk x on x.framework = 'NIST 800-53' and x.control_id in (d.control_id, d.padded)".replace("select distinct control_id, scf_id", "select distinct d.control_id, scf_id")})


def _resource_map(s: SparkSession, d: str) -> DataFrame:
    """Backbone controls of sensitive resources, by the 800-53 controls that they declare or that rules give them."""
    own = _resources(s, d).filter("security_sensitive").select(*_RC, F.explode("control_ids").alias("control_id")).filter("control_id rlike '^(AC|AU|CA|CM|CP|IA|IR|MP|RA|SC|SI)-'").withColumn("framework", F.lit("NIST 800-53"))
    scf = crosswalk.framework_to_scf(own.select("control_id", "framework").distinct(), catalog(s, "scf_crosswalk"))
    met = own.join(scf.select("control_id", "framework", "scf_id"), ["control_id", "framework"])
    return met.groupBy(*_RC).agg(F.array_join(F.sort_array(F.collect_set("scf_id")), ",").alias("controls"))


# --- registries, snapshots, notices ----------------------------------------
_MORE = _MAPS | {f"c_{n}": catalog_sql(n) for n in ("prefix_map", "sections", "duties", "cadences")} | {
    "by_class": "select req_id, name, statement, class_id, force from (unpivot (select * exclude (ord) from c_duties) on a, b, c, d into name class_id value force)",
    "matrix": "select req_id, name, class_id, case when force <> '' then force else 'APPLICABLE' end as force from by_class where force <> '' or statement <> ''",
    "musts": "select class_id, array_to_string(list_sort(list(req_id || ' (' || name || ')'))[1:4], ', ') as documents from matrix where force = 'MUST' group by class_id",
    "ask_terms": "select doc_id, version_ord, statement_id, stmt_ord, generate_subscripts(t, 1) - 1 as k, lower(unnest(t)) as term from (select *, case when len(framework_ids) > 0 then framework_ids[1:2] else list_transform(keywords[1:1], lambda k: replace(k, '_', ' ')) end as t from statements)",
}


def _duties(s: SparkSession, d: str) -> DataFrame:
    forces = F.map_filter(F.create_map(*[x for c in registry.CLASSES for x in (F.lit(c), F.col(c))]), lambda _, v: v != "")
    return registry.doc_matrix(catalog(s, "duties").withColumn("by_class", forces))


register("active_assessments", lambda s, d: registry.active_assessments(infra.assessments(s, d)).select("assessment_id", F.array_join("frameworks", ",").alias("frameworks"), "class_id"), "select assessment_id, array_to_string(frameworks, ',') as frameworks, class_id from asm where status = 'active'", _MORE)
register("upsert_assessments", lambda s, d: registry.upsert_assessments(infra.assessments(s, d), infra.assessments(s, d).filter("status = 'closed'").withColumn("status", F.lit("renewed"))).select("assessment_id", "status"), "select assessment_id, case status when 'closed' then 'renewed' else status end as status from asm", _MORE)
register("documentation_actions", lambda s, d: registry.documentation_actions(registry.active_assessments(infra.assessments(s, d)), infra.assessments(s, d), registry.doc_musts(_duties(s, d)), catalog(s, "cadences")), "select assessment_id, class_id, documents, coalesce(number || ' ' || unit, '') as cadence from asm join musts using (class_id) left join c_cadences using (class_id) where status = 'active'", _MORE)
register("report_rows", lambda s, d: registry.report_rows(statements(s, d), hits(s, d)).select("doc_id", "version_ord", F.explode("statements").alias("x")).select("doc_id", "version_ord", "x.statement_id", F.array_join(F.transform("x.hits", lambda h: F.concat_ws(":", h["source"], h["control_id"])), ",").alias("hits")), "select doc_id, version_ord, statement_id, coalesce(h, '') as hits from statements left join (select doc_id, version_ord, statement_id, string_agg(source || ':' || control_id, ',' order by source, hit_ord, framework, control_id) as h from hits group by all) using (doc_id, version_ord, statement_id)", _MORE)
register("statement_lists", lambda s, d: lineage.load_statements(lineage.statement_lists(lineage.commit_snapshots(policies(s, d)), statements(s, d)), statements(s, d).select("statement_id", "text").distinct()).withColumn("place", F.col("place").cast("long")), "select snapshot_id, row_number() over (partition by doc_id, version_ord order by stmt_ord) - 1 as place, statement_id, text from snaps join statements using (doc_id, version_ord)", _SNAP)
register("read_markdown", lambda s, d: lineage.read_markdown(lineage.commit_snapshots(policies(s, d)), policies(s, d).select(F.sha2("markdown", 256).alias("markdown_hash"), "markdown").distinct()), "select snapshot_id, markdown from snaps join pol using (doc_id, version_ord)", _SNAP)
register("snapshot_hits", lambda s, d: crosswalk.snapshot_hits(statements(s, d), catalog(s, "prefix_map")).drop("confidence"), f"select {_K}, target as framework, control_id, title, nth as hit_ord from (select {_K}, target, c.control_id, c.title, row_number() over (partition by {_K} order by k, c.ord) as nth from cited t join c_prefix_map c on upper(t.control_id[1:2]) = prefix) where nth <= 10", _MORE)
register("section_hits", lambda s, d: crosswalk.section_hits(statements(s, d), catalog(s, "sections")).drop("confidence"), f"select {_K}, section_id, name, nth as hit_ord from (select *, row_number() over (partition by {_K} order by place, section_id) as nth from (select {_K}, section_id, name, min((k, ord)) as place from ask_terms join c_sections on contains(lower(section_id || ' ' || name), term) group by all)) where nth <= 8", _MORE)
register("scf_reverse", lambda s, d: crosswalk.scf_reverse(hits(s, d).filter("framework = 'SCF'"), catalog(s, "scf_crosswalk").filter("framework = 'NIST 800-53'"), catalog(s, "scf_crosswalk").groupBy("framework", "control_id").agg(F.min("ord").alias("ord"), F.collect_list("scf_id").alias("scf_ids"))), "select control_id, framework, other, nth from (select h.control_id, x.framework, x.control_id as other, row_number() over (partition by h.control_id order by first, x.framework, x.control_id) as nth from (select distinct control_id from hits where framework = 'SCF' and control_id not in (select scf_id from c_scf_crosswalk where framework = 'NIST 800-53')) h join (select *, min(ord) over (partition by framework, control_id) as first from c_scf_crosswalk) x on x.scf_id = h.control_id) where nth <= 8", _MORE)
register("finding_fingerprint", lambda s, d: monitor.finding_fingerprint(_of_links(s, d), "link_id"), "select link_id, count(*) as n, sha256(string_agg(kind || '|' || severity || '|' || link_id || '|' || iac_ref, chr(10) order by kind || '|' || severity || '|' || link_id || '|' || iac_ref)) as fingerprint from change_set_ where link_id <> '' group by link_id", _MORE)
register("input_fingerprint", lambda s, d: monitor.input_fingerprint(infra.files(s, d).select("repository", "revision", F.col("relative_path").alias("path"), F.sha2("content", 256).alias("digest"))), "select repository, revision, sha256(string_agg(relative_path || '|' || sha256(content), chr(10) order by relative_path)) as fingerprint from files_ group by all", _MORE)
register("notification_payload", lambda s, d: monitor.notification_payload(_of_links(s, d).table(), "link_id", 3), f"select link_id, count(*) as n, string_agg(severity || '|' || kind || '|' || link_id || '|' || iac_ref, chr(10) order by nth) filter (where nth <= 3) as findings from (select *, row_number() over (partition by link_id order by {change_rules.severity_rank('severity')} desc, kind, link_id, iac_ref) as nth from change_set_ where link_id <> '') group by link_id", _MORE)
def _link_cases(s: SparkSession, d: str) -> DataFrame:
    """Links whose statement's kind, strength and polarity are stated, against what the rules say."""
    return evaluate.eval_cases(infra.links(s, d).filter("expected_kind is not null").select((F.col("doc_id") % 3).alias("suite"), F.col("link_id").alias("case_id"), F.map_filter(F.create_map(F.lit("kind"), "expected_kind", F.lit("strength"), "expected_strength", F.lit("polarity"), "expected_polarity"), lambda _, v: v.isNotNull()).alias("values")), _now(_matched(s, d)).join(statements(s, d).drop("content_hash"), ["doc_id", "version_ord", "statement_id"]).select(F.col("link_id").alias("case_id"), F.create_map(F.lit("kind"), "statement_kind", F.lit("strength"), "strength", F.lit("polarity"), "action_polarity").alias("values")))


_LINK_CASES = """select suite, case_id, array_to_string(f, ',') as failed, len(f) = 0 as passed from (select l.doc_id % 3 as suite, l.link_id as case_id, list_filter([case when expected_kind is distinct from statement_kind then 'kind' end, case when expected_polarity is not null and expected_polarity is distinct from action_polarity then 'polarity' end, case when expected_strength is distinct from strength then 'strength' end], lambda x: x is not null) as f from lnk l left join (select link_id, doc_id, statement_id, version_ord from matched where version_ord = 2) m using (link_id) left join statements s on s.doc_id = m.doc_id and s.version_ord = m.version_ord and s.statement_id = m.statement_id where expected_kind is not null)"""
register("eval_cases", _link_cases, _LINK_CASES, _MORE)

# --- monitoring, evaluation ------------------------------------------------
_LADDER = "case when {0} >= 3 then 'misaligned' when {0} >= 1 then 'review_required' else 'aligned' end"
register("monitor_status", lambda s, d: monitor.monitor_status(infra.runs(s, d)), f"select monitor_id, n, bad, latest, {change_rules.severity_name('r')} as worst, {_LADDER.format('r')} as standing from (select monitor_id, count(*) as n, count(*) filter (where status <> 'aligned') as bad, last(status order by run_ts, run_id) as latest, max({change_rules.severity_rank('severity')}) as r from runs_ group by monitor_id)", _INFRA)
register("state_transition", lambda s, d: monitor.state_transition(infra.runs(s, d)).select("monitor_id", "run_id", "transition"), "select monitor_id, run_id, transition from trans", _INFRA)
register("occurrence_tracking", lambda s, d: monitor.occurrence_tracking(infra.runs(s, d)).select("monitor_id", "run_id", "occurrence_count", F.coalesce(F.col("first_seen").cast("string"), F.lit("")).alias("first_seen"), F.coalesce(F.col("last_seen").cast("string"), F.lit("")).alias("last_seen"), F.coalesce("accepted", F.lit("")).alias("accepted")),
    "select monitor_id, run_id, case when status <> 'aligned' then row_number() over w else 0 end as occurrence_count, case when status <> 'aligned' then cast(min(run_ts) over w as varchar) else '' end as first_seen, case when status <> 'aligned' then cast(run_ts as varchar) else '' end as last_seen, coalesce(last_value(case when status = 'aligned' then input end ignore nulls) over (partition by monitor_id order by run_ts, run_id rows between unbounded preceding and current row), '') as accepted from stretches window w as (partition by monitor_id, stretch order by run_ts, run_id)", _INFRA)
_SENT = _INFRA | {
    "acks": infra.outcomes_sql(),
    "loud_": f"select *, status <> 'aligned' and {change_rules.severity_rank('severity')} >= 3 as loud, status = 'aligned' and coalesce(lag(status) over (partition by monitor_id order by run_ts, run_id), '') in ('misaligned', 'review_required') as recovers from runs_",
    "delivered_": "select l.monitor_id, a.ts, a.run_id, finding, input, loud, recovers from acks a join loud_ l using (monitor_id, run_id) where delivered",
    "opened_": "select *, exists (select 1 from delivered_ d where d.monitor_id = l.monitor_id and d.loud and (d.ts < l.run_ts)) as known from loud_ l",
    "wanted_": "select *, recovers and known as recovered, loud or (recovers and known) as wanted from opened_",
    "sent_": "select w.monitor_id, w.run_id, w.run_ts, w.wanted, w.recovered, w.finding, w.input, (select arg_max({'finding': p.finding, 'input': p.input}, (p.run_ts, p.run_id)) from wanted_ p join acks a using (monitor_id, run_id) where p.monitor_id = w.monitor_id and p.wanted and a.delivered and a.ts < w.run_ts) as last from wanted_ w",
    "decided_": "select monitor_id, run_id, case when recovered then 'recovered' when wanted then 'misaligned' else 'none' end as event, case when not wanted then 'quiet' when last is not null and last.finding = finding and last.input = input then 'suppressed' else 'sent' end as decision from sent_",
}


def _decided(s: SparkSession, d: str) -> DataFrame:
    return monitor.notify_decision(infra.runs(s, d), infra.outcomes(s, d))


register("notify_decision", _decided, "select * from decided_", _SENT)
register("notification_outbox", lambda s, d: monitor.outbox(_decided(s, d), infra.outcomes(s, d)), "select monitor_id, run_id, event, case when delivered then 'delivered' else 'failed' end as state from decided_ join acks using (monitor_id, run_id) where decision = 'sent'", _SENT)


def _cases(s: SparkSession, d: str) -> DataFrame:
    pairs = impact.change_kinds(rewordings(s, d))
    return pairs.select(F.col("before_strength").alias("suite"), F.col("before_strength").alias("expected"), F.col("after_strength").alias("actual"))


register("exact_metric", lambda s, d: evaluate.exact_metric(_cases(s, d)), "select before_strength as suite, count(*) as cases, round(avg(case when before_strength = after_strength then 1.0 else 0.0 end::double), 6) as accuracy from reworded2 group by 1", _CHANGE)
register("quality_gate", lambda s, d: evaluate.quality_gate(_link_cases(s, d)), f"select suite, count(*) as cases, count(*) filter (where not passed) as failed_cases, round(avg(passed::integer), 6)::double as accuracy, round(avg(passed::integer), 6) >= 0.95 and bool_and(passed) as passed from ({_LINK_CASES}) group by suite", _MORE)
_BOTH = {"sides": "select doc_id, max(keywords) filter (where version_ord = 1) as e, max(keywords) filter (where version_ord = 2) as a from (select doc_id, version_ord, list_distinct(flatten(list(keywords))) as keywords from statements group by all) group by doc_id", "counted": "select doc_id % 3 as suite, sum(len(list_intersect(e, a))) as tp, sum(len(a) - len(list_intersect(e, a))) as fp, sum(len(e) - len(list_intersect(e, a))) as fn from sides group by 1"}


def _label_cases(s: SparkSession, d: str) -> DataFrame:
    tags = statements(s, d).select("doc_id", "version_ord", F.explode("keywords").alias("k")).groupBy("doc_id").pivot("version_ord", [1, 2]).agg(F.collect_set("k"))
    return tags.select((F.col("doc_id") % 3).alias("suite"), F.col("1").alias("expected"), F.col("2").alias("actual"))


register("label_metric", lambda s, d: evaluate.label_metric(_label_cases(s, d)), "select suite, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1 from (select *, tp::double / (tp + fp) as p, tp::double / (tp + fn) as r from counted)", _BOTH)


# --- export, questionnaires ------------------------------------------------
register("document_title", lambda s, d: export.document_title(policies(s, d)), "select doc_id, version_ord, regexp_extract(markdown, '(?m)^\\s*#+\\s*(.*?)\\s*$', 1) as title from pol")
register("oscal_component", lambda s, d: export.component_rows(hits(s, d)), "select doc_id, version_ord, control, statement_id, source from (select *, upper(control_id) as control, row_number() over (partition by doc_id, version_ord, upper(control_id) order by stmt_ord, source) as nth from hits where framework = 'NIST 800-53') where nth = 1", HITS)
register("oscal_assessment", lambda s, d: export.assessment_rows(statements(s, d), hits(s, d)), "select doc_id, version_ord, statement_id, coalesce(list_extract(heading_path, -1), 'Obligation') as title, coalesce(array_to_string(controls, ';'), '') as controls from statements left join (select doc_id, version_ord, statement_id, list_sort(list_distinct(list(control_id)))[1:8] as controls from hits group by all) using (doc_id, version_ord, statement_id) where strength in ('must', 'shall', 'prohibited')", HITS)
_UUID = lambda *parts: "(select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 13, 3) || '-8' || substr(h, 16, 3) || '-' || substr(h, 19, 12) from (select sha256(" + " || '|' || ".join(parts) + ") as h))"
_PROPS = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("=", p["name"], p["value"])), ";")
_DOC = ("'pol-' || doc_id", "version_ord::varchar")


def _needs(s: SparkSession, d: str) -> DataFrame:
    whole = export.component_definition(statements(s, d), hits(s, d), "Corporate policy", "2026-01-01T00:00:00Z")
    part = whole.select("doc_id", "version_ord", F.col("definition.component-definition.uuid").alias("definition"), F.explode("definition.component-definition.components").alias("c"))
    need = part.select("doc_id", "version_ord", "definition", F.explode(F.col("c.control-implementations")[0]["implemented-requirements"]).alias("n"))
    return need.select("doc_id", "version_ord", "definition", "n.uuid", F.col("n.control-id").alias("control_id"), "n.description", _PROPS(F.col("n.props")).alias("props"))


def _results(s: SparkSession, d: str) -> DataFrame:
    whole = export.assessment_results(statements(s, d), hits(s, d), "Corporate policy", "2026-01-01T00:00:00Z")
    held = whole.select("doc_id", "version_ord", F.explode("results.assessment-results.results").alias("r"))
    return held.select("doc_id", "version_ord", "r.uuid", "r.title", "r.description", _PROPS(F.col("r.props")).alias("props"), "r.status.state")


register("oscal_component_nested", _needs, f"""select doc_id, version_ord, {_UUID("'definition'", *_DOC)} as definition, {_UUID("'requirement'", *_DOC, "control")} as uuid, lower(control) as control_id, text as description, 'policy-statement-id=' || statement_id || ';obligation-strength=' || strength || ';mapping-source=' || source as props
    from (select doc_id, version_ord, statement_id, source, upper(control_id) as control, row_number() over (partition by doc_id, version_ord, upper(control_id) order by stmt_ord, source) as nth from hits where framework = 'NIST 800-53') join statements using (doc_id, version_ord, statement_id) where nth = 1""", HITS)
register("oscal_assessment_nested", _results, f"""select doc_id, version_ord, {_UUID("'result'", *_DOC, "statement_id")} as uuid, coalesce(list_extract(heading_path, -1), 'Obligation') as title, text as description, 'statement-id=' || statement_id || ';mapped-controls=' || coalesce(mapped, '') as props, 'satisfied_as_documented' as state
    from statements left join (select doc_id, version_ord, statement_id, string_agg(framework || ':' || control_id, ', ' order by nth) as mapped from (select *, row_number() over (partition by doc_id, version_ord, statement_id order by source, hit_ord, framework, control_id) as nth from hits) where nth <= 8 group by all) using (doc_id, version_ord, statement_id) where strength in ('must', 'shall', 'prohibited')""", HITS)


def _manifests(s: SparkSession, d: str) -> DataFrame:
    """Links as JSON manifests of ten, as written by people: some with fields that nobody knows, values that don't exist, or another version."""
    ln = infra.links(s, d)
    fields = {"link_id": F.when(F.col("doc_id") % 30 == 7, "lnk-x").otherwise(F.col("link_id")), "doc_id": F.concat(F.lit("pol-"), "doc_id"), "statement_anchor": F.col("anchor"), "expected_statement_kind": F.when(F.col("doc_id") % 8 == 5, "wish").otherwise(F.col("expected_kind")), "expected_strength": F.col("expected_strength"), "expected_action_polarity": F.coalesce("expected_polarity", F.lit("positive")), "surprise": F.when(F.col("doc_id") % 10 == 3, "x")}
    link = F.struct("doc_id", F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("text"))
    many = ln.withColumn("file", F.floor(F.col("doc_id") / 10).cast("long")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(link)), lambda x: x["text"]), ", ").alias("links"))
    version = F.when(F.col("file") % 7 == 4, "2").otherwise("1")
    more = F.when(F.col("file") % 9 == 5, ', "comment": "none"').otherwise("")
    value = F.when(F.col("file") % 11 == 6, "{ no JSON").otherwise(F.concat(F.lit('{"schema_version": '), version, more, F.lit(', "links": ['), "links", F.lit("]}")))
    return many.select(F.concat(F.lit("links-"), "file", F.lit(".json")).alias("path"), value.alias("value"))


register("manifest_violations", lambda s, d: registry.manifest_violations(_manifests(s, d)), """select distinct path, '' as link_id, case when file % 11 = 6 then 'not a JSON object' when file % 9 = 5 then 'unknown field comment' end as problem from in_files where file % 11 = 6 or file % 9 = 5
    union all select distinct path, '', 'schema_version is not 1' from read_ where file % 7 = 4
    union all select distinct path, named, problem from (select path, named, unnest(list_filter([case when doc_id % 10 = 3 then 'unknown field surprise' end, case when expected_kind is null and doc_id % 8 <> 5 then 'expected_statement_kind missing' end, case when expected_strength is null then 'expected_strength missing' end, case when doc_id % 8 = 5 then 'expected_statement_kind has no such value' end,
        case when (select count(*) from read_ o where o.path = r.path and o.named = r.named) > 1 then 'link_id not unique' end], lambda x: x is not null)) as problem from read_ r)""", _INFRA | {
    "in_files": "select *, doc_id // 10 as file, 'links-' || (doc_id // 10) || '.json' as path, case when doc_id % 30 = 7 then 'lnk-x' else link_id end as named from lnk",
    "read_": "select * from in_files where file % 11 <> 6",
})
register("ksi_coverage", lambda s, d: export.indicator_coverage(hits(s, d), catalog(s, "ksi"), "a"), "select doc_id, version_ord, count(*) filter (where a <> 'optional') as demanded, count(*) filter (where a = 'optional') as optional from (select distinct doc_id, version_ord, control_id from hits where source = 'ksi') h join c_ksi k on k.ksi_id = h.control_id where a <> 'not_applicable' group by all", HITS)
_ASK = {
    "asked": "select event_id as question_id, concat_ws(' ', 'How do you review', ['privileged access', 'vendor contracts', 'backup media', 'incident logs', 'network boundary'][cast(event_id % 5 as int) + 1], event_type) as text from events",
    "words_": "select distinct text, word from (select text, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as word from (select distinct text from asked)) where length(word) > 2",
    "names_": "select doc_id, version_ord, statement_id, count(*) as n, array_to_string(list_sort(list_distinct(list(lower(control_id || ' ' || title)))), ' ') as names from hits group by all",
    "hays": "select s.*, lower(concat_ws(' ', text, array_to_string(keywords, ' '), array_to_string(heading_path, ' '), names)) as hay, case strength when 'must' then 0.4 when 'shall' then 0.4 when 'prohibited' then 0.35 when 'should' then 0.2 when 'may' then 0.05 else 0 end::double + least(0.5::double, 0.05::double * coalesce(n, 0)) as extra from statements s left join names_ using (doc_id, version_ord, statement_id)",
    "scored_": "select words_.text, doc_id, version_ord, stmt_ord, statement_id, count(*) + max(extra) as score from words_ join hays on contains(hay, word) group by all",
}
register("questionnaire_topk", lambda s, d: coverage.questionnaire_topk(_questions(s, d), statements(s, d), hits(s, d)), "select question_id, rank, statement_id, round(score, 2) as score from asked join (select *, row_number() over (partition by text order by round(score, 9) desc, doc_id, version_ord, stmt_ord) as rank from scored_) using (text) where rank <= 5", HITS | _ASK)
