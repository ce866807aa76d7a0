"""What must not grow with the corpus: sides that joins broadcast, pairs that joins meet, patterns read again."""

import os
import re

import pytest

from ctrlspark.operators import crosswalk, extract, iac, registry
from ctrlspark.plans import queries as policy
from ctrlspark.sources.catalogs import _TABLES, catalog
from ctrlspark.sources.corpus import policies
from ctrlspark.sources.tables import built, staged

SF = "/root/testdata/sf0.001"


def broadcast_tables(df) -> list[str]:
    """Built tables below a broadcast in the plan of ``df``."""
    found, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = re.search(r"[A-Za-z*]", line)
        if not at or not re.match(r"^[ :+\-]*(\*\(|[A-Z])", line):
            continue
        if depth is not None and at.start() <= depth:
            depth = None
        if depth is None and "BroadcastExchange" in line:
            depth = at.start()
        elif depth is not None and "ctrlspark-tables" in line:
            found.append(line.strip()[:120])
    return found


@pytest.mark.parametrize("name", ["scf_expand", "ksi_map_statement", "coverage_gaps", "evidence_packet", "report_rows", "oscal_component", "oscal_component_nested", "oscal_assessment", "oscal_assessment_nested", "framework_labels", "mapping_assessments", "ksi_coverage", "statement_diff", "drift", "link_statement", "explicit_titles"])
def test_statements_and_hits_are_not_broadcast(spark, name):
    # files of these tables are far below the planner's bound, as a compressed table of a million rows is
    assert broadcast_tables(policy.QUERIES[name](spark, SF)) == []


@pytest.mark.parametrize("name", _TABLES)
def test_catalogs_have_a_known_size(spark, name):
    rows, schema = _TABLES[name]
    table = catalog(spark, name)
    assert sorted(map(tuple, table.collect())) == sorted((*r, i) for i, r in enumerate(rows))
    assert table.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    assert int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000


def test_assessments_meet_their_documents_by_key(spark):
    rows = spark.createDataFrame([(1, "SOC 2"), (2, "SOC 2"), (3, "PCI DSS")], "doc_id long, framework string")
    active = spark.createDataFrame([("all", "SOC 2", []), ("one", "SOC 2", [1, 1]), ("none", "SOC 2", [9]), ("null", "SOC 2", None), ("pci", "PCI DSS", [3, 1])], "assessment_id string, framework string, doc_ids array<long>")
    met = registry.with_assessments(rows, active)
    assert sorted((r.doc_id, r.framework, r.assessment_id) for r in met.collect()) == [(1, "SOC 2", "all"), (1, "SOC 2", "one"), (2, "SOC 2", "all"), (3, "PCI DSS", "pci")]


def test_patterns_are_read_once_a_clause(spark):
    clauses = spark.createDataFrame([(1, 1, "Owners MAY cause delays and CANNOT verify AC-2.", ["Scope"])], "doc_id long, version_ord int, clause string, heading_path array<string>")
    s = extract.classify_statement(extract.candidate_filter(clauses))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("must never") <= 6  # 7 before, and more where the clause itself was an expression
    row = s.first()
    assert (row.verbs, row.framework_ids, row.statement_kind, row.keywords) == ([], ["AC-2"], "citation", [])


def test_lines_are_structured_once_and_never_shuffled(spark):
    s = extract.extract_statements(policies(spark, SF))
    plan = s._jdf.queryExecution().executedPlan().toString()
    # before: lines were shuffled by size, for prose and for tables, and again as blocks
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert len(re.findall(r"Generate posexplode\(arrays_zip", plan)) == 1
    assert s.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_prose_and_tables_side_by_side(spark):
    text = "Owners must:\n- rotate keys\n| A | B |\n |---|:---:| \n| x | |\n| | |\n- sign in\nand wrap\n|---|\n|---|\nTail | must stay|\n"
    docs = spark.createDataFrame([(1, 1, text)], "doc_id long, version_ord int, markdown string")
    blocks = extract.block_assembly(docs).orderBy("line_ord").collect()
    # the table stops the list, so its lead ends there
    assert [(r.line_ord, r.text) for r in blocks] == [(1, "Owners must rotate keys"), (4, "x"), (6, "sign in and wrap"), (10, "Tail | must stay|")]
    assert [text[r.start :][:5] for r in blocks] == ["Owner", "x | |", "sign ", "Tail "]


def test_hits_are_planned_source_by_source(spark):
    statements = policy.statements(spark, SF)
    tables = [catalog(spark, n) for n in ("scf", "scf_crosswalk", "seed", "ksi", "ksi_words")]
    parts = [part() for part in crosswalk.hit_parts(statements, *tables)]
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in parts]
    assert max(p.count("BroadcastExchange") for p in plans) <= 5  # 12 in one job before
    assert sorted(r.source for p in parts for r in p.select("source").distinct().collect()) == ["explicit-citation", "ksi", "scf", "seed"]
    whole, built = crosswalk.map_statements(statements, *tables), policy.hits(spark, SF)
    assert built.count() == whole.count() and built.exceptAll(whole).count() == 0


def test_rules_are_evaluated_once_a_text(spark):
    text = "# Access\nOwners must review access; they shall log it under AC-2.\n\nOwners must:\n- rotate keys\n## Backup\n| A | B |\n|---|---|\n| Rule | Staff may approve. |\n"
    texts = [text, text + "\n# \nOwners must review access; they shall log it under AC-2.\n", "", None, "Owners must review access; they shall log it under AC-2."]
    once, more = (spark.createDataFrame([(n * 10 + i, v, t) for n in range(copies) for i, t in enumerate(texts) for v in (1, 2)], "doc_id long, version_ord int, markdown string") for copies in (1, 4))
    blocks = [extract.block_assembly(d).selectExpr("*", "array_join(heading_path, ' ') as under") for d in (once, more)]
    # two, one and one below headings, two below none or an empty one; copies of documents and their versions add none
    assert [extract.text_clauses(b).count() for b in blocks] == [6, 6]
    whole = extract.extract_statements(more)
    for few, join in ((extract.FEW, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        found = extract.extract_corpus(more, few)
        assert join in found._jdf.queryExecution().executedPlan().toString()
        assert found.schema.simpleString() == whole.schema.simpleString() and found.count() == whole.count() > 0
        assert found.exceptAll(whole).count() == 0


def test_blocks_are_assembled_once_from_few_windows(spark):
    structured = extract.structured_lines(policies(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert structured.count("Window [") <= 4  # with what blocks need
    found = extract.extract_corpus(policies(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(arrays_zip" not in found and found.count("FileScan parquet") == 2  # lines were structured again for the clauses


def test_lines_split_with_and_without_a_pattern(spark):
    texts = ["", "\n", "a\n\nb", "a\nb\n", "é\n```\nx\n```\n", "a\r\nb\rc\n", "a\x0bb\x0cc\x85d e f\n\r", None]
    docs = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, version_ord int, markdown string")
    rows = extract.lines_explode(docs).orderBy("doc_id", "line_ord").collect()
    ends = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
    want = [(i, k, line, at) for i, t in enumerate(texts) if t is not None for k, (line, at) in enumerate(zip(ends.split(t), [0, *(m.end() for m in ends.finditer(t))]))]
    assert [(r.doc_id, r.line_ord, r.line, r.offset) for r in rows] == want


def test_built_tables_leave_nothing_behind(spark):
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    made, full = [], beans()

    def part(n):
        table = staged(spark.range(n), "step")
        made.extend(f.removeprefix("file:") for f in table.inputFiles())
        return table.selectExpr("id % 3 as id").distinct()

    table = built(spark, SF, "left", lambda: part(5), lambda: part(7))
    assert made and not any(map(os.path.exists, made))
    assert beans() >= full + 2
    assert sorted(r.id for r in table.collect()) == [0, 0, 1, 1, 2, 2]


def test_files_are_parsed_in_batches_and_cut_once(spark):
    block = 'resource "t" "r%d" {\n  x = "é"\n}\n'
    text = "# é\n" + "".join(block % i for i in range(5000)) + "locals {}\n"
    batches = list(iac._resource_rows(iter([("r", 1, "m/main.tf", text), ("r", 2, "m/main.tf", None)])))
    # one table of all files' resources before, whatever their number
    assert [b.num_rows for b in batches] == [2000, 2000, 1000]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["start_line"] for r in rows] == [2 + 3 * i for i in range(5000)] and all(text[r["span_start"] : r["span_end"]] == r["block"] for r in rows)
    files = spark.createDataFrame([("r", 1, "m/main.tf", text), ("r", 2, "m/main.tf", text.replace("locals", "others")), ("r", 1, "n/main.tf", text), ("r", 2, "n/main.tf", text + "\n \t\n"), ("r", 2, "m/x.json", "{}")], "repository string, revision int, relative_path string, content string")
    resources = iac.iac_extract(files)
    prints = iac.outside_fingerprint(files.filter("relative_path like '%.tf'"), resources)
    # the text was searched from its start for each resource before
    assert "zip_with" not in prints._jdf.queryExecution().optimizedPlan().toString()
    same = {(r.relative_path, r.revision): r.outside for r in prints.collect()}
    assert same["m/main.tf", 1] == same["n/main.tf", 1] == same["n/main.tf", 2] != same["m/main.tf", 2]
    seen = iac.unclassified_file_change(files, resources, 1, 2)
    assert seen._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # to see which resources moved
    assert {tuple(r) for r in seen.collect()} == {("r", "m/main.tf", "changed", False), ("r", "n/main.tf", "changed", False), ("r", "m/x.json", "added", False)}
