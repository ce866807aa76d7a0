"""Five labelled suites of our own cases with their gate; manifests, exports, phrases, paths and lineage on small tables."""

import json
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from ctrlspark.functions import phrases
from ctrlspark.operators import coverage, crosswalk, evaluate, export, lineage, reconcile, registry
from ctrlspark.sources.catalogs import catalog

EXPECTED = "suite string, case_id long, values map<string,string>, domains array<string>"
POLICY = [
    ("Admins must review privileged accounts.", {"kind": "obligation", "strength": "must", "action_polarity": "positive", "domains": "access_control"}),
    ("Vendors must not store personal data.", {"kind": "prohibition", "strength": "prohibited", "action_polarity": "negative", "domains": "privacy,vendor"}),
    ("Operators should encrypt backups.", {"kind": "recommendation", "strength": "should", "domains": "backup,encryption"}),
    ("Managers may approve visitors.", {"kind": "permission", "strength": "may", "domains": "physical"}),
    ("Audit logs are described under AU-2 of the catalog.", {"kind": "citation", "strength": "descriptive", "domains": "logging"}),
    ("The weather is mild in spring.", {"extract": "false"}),
    ("Does a vendor have to sign?", {"extract": "false"}),
    ("Staff must disable unused accounts.", {"action_polarity": "negative"}),
]
IAC = [
    ("aws_kms_key", "enable_key_rotation = true", {}, {}, {"security_sensitive": "true", "domains": "encryption"}),
    ("null_resource", "x = 1", {}, {}, {"security_sensitive": "false", "domains": "", "control_ids": "", "status": "not_security_relevant", "posture": "unknown"}),
    ("aws_ebs_volume", "encrypted = false", {}, {}, {"domains": "encryption", "status": "misconfigured", "posture": "violated"}),
    ("null_resource", "run = <<EOF\nencrypted = false\nEOF", {}, {}, {"security_sensitive": "false", "posture": "unknown"}),
    ("null_resource", "", {"control_ids": "AC-2"}, {}, {"security_sensitive": "true", "control_ids": "AC-2", "status": "reviewed_annotation", "posture": "implemented"}),
    ("null_resource", 'cidr = ["0.0.0.0/0"]', {}, {"grc_posture": "approved"}, {"domains": "network_security", "control_ids": "AC-4,SC-7", "posture": "implemented"}),
    ("null_resource", "", {"control_id": "nonsense"}, {}, {"status": "review_required", "posture": "review_required"}),
]
CHANGES = [
    ("Teams must review logs weekly.", "Teams must review logs daily.", "sla_changed"),
    ("All teams must encrypt backups.", "Selected teams must encrypt backups.", "scope_reduced"),
    ("Owners must test recovery.", "Owners should test recovery.", "obligation_softened"),
    ("# Access\n\nAccounts must use MFA.", "# Identity and Access\n\nAccounts must use MFA.", "non_material_rewording"),
    ("# Access\n\nAccounts must use MFA.", "# Production Access\n\nAccounts must use MFA.", "obligation_rewritten"),
    ("Owners must test recovery.", "", "obligation_removed"),
    ("", "Owners must test recovery.", "obligation_added"),
    ("Owners must test recovery plans.", "Visitors shall wear a badge in each facility.", "obligation_added,obligation_removed"),
    ("Owners must test recovery.", "Owners must test recovery.", ""),
]
ALIGNMENT = [
    ("Data must be encrypted at rest.", "aws_kms_key", "x = 1", "encryption", "encryption"),
    ("Visitors must sign in.", "aws_kms_key", "x = 1", "physical", "encryption"),
]
SCF = [(["encryption"], [], 0.9, "CRY-01,CRY-05"), ([], ["AC-2"], 0.5, None), ([], [], 0.9, "")]
NOTES = "case_id long, resource_type string, block string, annotations map<string,string>, tags map<string,string>"


def expected(spark, suite, rows):
    return spark.createDataFrame([(suite, i, v, [d for d in v.get("domains", "").split(",") if d]) for i, v in enumerate(rows)], EXPECTED)


def judged(want, got):
    cases = evaluate.eval_cases(want, got)
    assert [(r.case_id, r.failed) for r in cases.filter("not passed").collect()] == []
    return cases


def test_policy_and_iac_suites_with_labels_and_gate(spark):
    want = expected(spark, "policy", [v for _, v in POLICY])
    got = evaluate.policy_suite(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(POLICY)], "case_id long, text string"))
    cases = judged(want, got)
    labelled = want.filter("values['domains'] is not null").select("suite", "case_id", F.col("domains").alias("expected")).join(got.select("case_id", F.col("domains").alias("actual")), "case_id")
    gate = evaluate.quality_gate(cases, evaluate.label_metric(labelled)).first()
    assert (gate.suite, gate.cases, gate.failed_cases, gate.accuracy, gate.passed) == ("policy", len(POLICY), 0, 1.0, True)
    wrong = labelled.withColumn("actual", F.array(F.lit("none")))
    assert not evaluate.quality_gate(cases, evaluate.label_metric(wrong)).first().passed
    one = cases.withColumn("passed", F.col("case_id") != 3)
    assert [(r.failed_cases, r.passed) for r in evaluate.quality_gate(one, least=0.5).collect()] == [(1, False)]  # one failed case closes the gate
    want = expected(spark, "iac", [v for *_, v in IAC])
    judged(want, evaluate.iac_suite(spark.createDataFrame([(i, t, b, n, g) for i, (t, b, n, g, _) in enumerate(IAC)], NOTES)))


def test_change_suite(spark):
    want = expected(spark, "changes", [{"kinds": k} for *_, k in CHANGES])
    judged(want, evaluate.change_suite(spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CHANGES)], "case_id long, before string, after string")))


def test_alignment_and_scf_suites(spark):
    rows = spark.createDataFrame([(i, p, t, b, {}, {}) for i, (p, t, b, *_) in enumerate(ALIGNMENT)], "case_id long, text string, resource_type string, block string, annotations map<string,string>, tags map<string,string>")
    want = expected(spark, "alignment", [{"policy_domains": p, "iac_domains": q, "aligned": str(p == q).lower()} for *_, p, q in ALIGNMENT])
    judged(want, evaluate.alignment_suite(rows))
    cases = spark.createDataFrame([(i, d, c, s) for i, (d, c, s, _) in enumerate(SCF)], "case_id long, domains array<string>, control_ids array<string>, source_confidence double")
    want = expected(spark, "scf", [{"confidence_capped": "true"} | ({} if ids is None else {"scf_control_ids": ids}) for *_, ids in SCF])
    judged(want, evaluate.scf_suite(cases, catalog(spark, "scf"), catalog(spark, "scf_crosswalk")))


# --- manifests --------------------------------------------------------------
GOOD = {"link_id": "a", "doc_id": "p", "expected_statement_kind": "obligation", "expected_strength": "must", "expected_action_polarity": "positive", "owner": "x"}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ({"schema_version": 1, "links": [GOOD, GOOD | {"link_id": "b"}]}, set()),
        ({"schema_version": 1, "links": []}, set()),
        ("{ broken", {("", "not a JSON object")}),
        ([GOOD], {("", "not a JSON object")}),
        ({"schema_version": 2, "links": [], "unexpected": True}, {("", "unknown field unexpected"), ("", "schema_version is not 1")}),
        ({"links": None}, {("", "schema_version is not 1"), ("", "no list of links")}),
        ({"schema_version": 1, "links": [GOOD, GOOD | {"moving": {"a": 1}}]}, {("a", "unknown field moving"), ("a", "link_id not unique")}),
        ({"schema_version": 1, "links": [{k: v for k, v in GOOD.items() if k != "expected_strength"} | {"expected_statement_kind": "wish"}, {}]},
         {("a", "expected_strength missing"), ("a", "expected_statement_kind has no such value"), *(("", f"{k} missing") for k in registry.DEMANDED)}),
    ],
)
def test_manifests(spark, body, want):
    text = body if isinstance(body, str) else json.dumps(body)
    got = registry.manifest_violations(spark.createDataFrame([("f.json", text)], "path string, value string"))
    assert {(r.link_id, r.problem) for r in got.collect()} == want


def test_defaults_of_assessments(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"assessment_id": "x", "name": "n"}, {"assessment_id": "y", "status": "closed", "doc_ids": ["p"]}]))
    rows = {r.assessment_id: (r.status, r.frameworks, r.doc_ids) for r in registry.load_assessments(spark, str(tmp_path / "a.json")).collect()}
    assert rows == {"x": ("active", [], []), "y": ("closed", [], ["p"])}


# --- exports ----------------------------------------------------------------
STATEMENT = "doc_id long, version_ord int, statement_id string, stmt_ord long, text string, strength string, heading_path array<string>"
HIT = "doc_id long, version_ord int, statement_id string, stmt_ord long, source string, hit_ord long, framework string, control_id string"


def test_nested_exports(spark):
    s = spark.createDataFrame([(1, 1, "s1", 1, "Users must log in.", "must", ["A", "B"]), (1, 1, "s2", 2, "Users may leave.", "may", []), (1, 1, "s3", 3, "Never share.", "prohibited", [])], STATEMENT)
    h = spark.createDataFrame([(1, 1, "s2", 2, "seed", 0, "NIST 800-53", "AC-2"), (1, 1, "s1", 1, "seed", 1, "NIST 800-53", "ac-2"), (1, 1, "s1", 1, "seed", 0, "SOC 2", "CC6.1")], HIT)
    made = [export.component_definition(s, t, "T", "2026-01-01T00:00:00Z").select(F.to_json("definition").alias("j")).first().j for t in (h, h.orderBy(F.desc("hit_ord")))]
    assert made[0] == made[1]  # the same content, the same document
    d = json.loads(made[0])["component-definition"]
    needs = d["components"][0]["control-implementations"][0]["implemented-requirements"]
    assert [(n["control-id"], n["description"], n["props"]) for n in needs] == [("ac-2", "Users must log in.", [{"name": "policy-statement-id", "value": "s1"}, {"name": "obligation-strength", "value": "must"}, {"name": "mapping-source", "value": "seed"}])]
    assert d["metadata"]["oscal-version"] == "1.1.2" and uuid.UUID(needs[0]["uuid"]).version == 8 and len({d["uuid"], d["components"][0]["uuid"], needs[0]["uuid"]}) == 3
    r = json.loads(export.assessment_results(s, h, "T", "2026-01-01T00:00:00Z").select(F.to_json("results").alias("j")).first().j)["assessment-results"]["results"]
    assert [(x["title"], x["props"][1]["value"], x["status"]["state"]) for x in r] == [("B", "SOC 2:CC6.1, NIST 800-53:ac-2", "satisfied_as_documented"), ("Obligation", "", "satisfied_as_documented")]


# --- indexes ----------------------------------------------------------------
def test_phrases(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcab"), (2, None), (3, ""), (4, "xyz bc"), (4, "xyz bc")], "id long, t string")
    known = spark.createDataFrame([("ab",), ("bc",), ("abc",), ("zz",), ("",), (None,), ("ab",)], "w string")
    for part in (100, 1):
        monkeypatch.setattr(phrases, "PART", part)
        got = sorted((r.id, r.w) for r in phrases.phrases_in(texts, "t", known, "w").collect())
        assert got == [(1, "ab"), (1, "abc"), (1, "bc"), (4, "bc"), (4, "bc")]
    assert phrases.phrases_in(texts, "t", known.limit(0), "w").count() == 0


def test_no_nested_loops(spark):
    statements = spark.createDataFrame([(1, 1, "s", 1, "Review account logs", ["logging"], ["AC-2"])], "doc_id long, version_ord int, statement_id string, stmt_ord long, text string, keywords array<string>, framework_ids array<string>")
    topic = crosswalk.ksi_by_topic(statements, catalog(spark, "ksi"), catalog(spark, "ksi_words"))
    sections = crosswalk.section_hits(statements, catalog(spark, "sections"))
    for df in (topic, sections):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        df.collect()


def test_paths(spark):
    paths = ["modules/brand1/main.tf", "modules/brand11/main.tf", "main.tf", "x/modules/brand1", "a"]
    wanted = ["modules/brand1", "modules/brand1/", "brand11/main.tf", "/root/modules/brand1/main.tf", "tf", "main.tf", "a", "zz", ""]
    held = spark.createDataFrame([(t, p) for t in ("t", "u") for p in paths], "resource_type string, path string")
    asked = spark.createDataFrame([("t", w) for w in wanted] + [("v", "main.tf")], "resource_type string, wanted string")
    got = {tuple(r) for r in reconcile.paths_below(asked, held).select("resource_type", "wanted", "path").collect()}
    assert got == {("t", w, p) for w in wanted for p in paths if w in p or w.endswith(p)}


# --- lineage ----------------------------------------------------------------
DOCS = "doc_id long, version_ord int, markdown string, base_version int"


def test_commits_and_branches(spark):
    rows = [(1, 1, "a", None), (1, 2, "b", None), (1, 3, "c", 1), (1, 4, "d", None), (2, 1, "a", None), (2, 1, "a", None)]
    held = lineage.commit(spark.createDataFrame(rows[:2], DOCS))
    later = lineage.commit(spark.createDataFrame(rows, DOCS), held)
    assert later["snapshots"].count() == 3 and {r.markdown for r in later["blobs"].collect()} == {"c", "d"} and later["log"].count() == 3
    every = held["snapshots"].unionByName(later["snapshots"])
    name = {(r.doc_id, r.version_ord): r.snapshot_id for r in every.collect()}
    parent = {r.snapshot_id: r.parent_snapshot_id for r in every.collect()}
    assert parent == {name[1, 1]: None, name[1, 2]: name[1, 1], name[1, 3]: name[1, 1], name[1, 4]: name[1, 3], name[2, 1]: None}
    got = sorted((r.doc_id, r.depth, r.snapshot_id) for r in lineage.history(every).collect())
    assert got == [(1, 0, name[1, 4]), (1, 1, name[1, 3]), (1, 2, name[1, 1]), (2, 0, name[2, 1])]  # version 2 is on another branch
    whole = {"blobs": held["blobs"].unionByName(later["blobs"]), "snapshots": every}
    again = lineage.commit(spark.createDataFrame(rows, DOCS), whole)
    assert all(t.count() == 0 for t in again.values())
    chain = spark.createDataFrame([(7, i, f"s{i}", f"s{i - 1}" if i else None) for i in range(37)], "doc_id long, version_ord int, snapshot_id string, parent_snapshot_id string")
    assert sorted((r.depth, r.snapshot_id) for r in lineage.history(chain).collect()) == [(36 - i, f"s{i}") for i in range(36, -1, -1)]


def _best(questions, statements, hits, k):
    """Every question against every statement, one by one."""
    bonus = {"must": 0.4, "shall": 0.4, "prohibited": 0.35, "should": 0.2, "may": 0.05}
    out = set()
    for qid, text in questions:
        words = {w for w in re.split("[^a-z0-9]+", (text or "").lower()) if len(w) > 2}
        rows = []
        for doc, ver, sid, nth, body, strength, keywords, headings in statements:
            own = [h for h in hits if h[:3] == (doc, ver, sid)]
            hay = " ".join([body, *keywords, *headings, *(f"{h[3]} {h[4]}" for h in own)]).lower()
            n = sum(w in hay for w in words)
            if n:
                rows.append((-round(n + bonus.get(strength, 0) + min(0.5, 0.05 * len(own)), 9), doc, ver, nth, sid))
        out |= {(qid, r, row[4], round(-row[0], 2)) for r, row in enumerate(sorted(rows)[:k], 1)}
    return out


@pytest.mark.parametrize("seeds, block", [(32, 50_000), (2, 3)])
def test_questions_against_all_statements(spark, monkeypatch, seeds, block):
    """A word in nearly all statements and questions, classes of equal statements beyond k, ties, lists split into parts."""
    rng = random.Random(11)
    vocabulary = [f"word{i:02d}" for i in range(24)]
    pick = lambda n: " ".join(rng.choices(vocabulary, weights=[40 // (i + 1) + 1 for i in range(24)], k=n))
    statements = [(d, v, f"s{d}-{v}-{i}", i, f"Users review {pick(rng.randint(1, 7))}", rng.choice(["must", "may", "descriptive"]), rng.sample(vocabulary, rng.randint(0, 2)), [pick(1)]) for d in range(12) for v in (1, 2) for i in range(8)]
    statements += [(50 + d, 1, f"same{d}", 0, "Users review word00 and word05", "must", [], []) for d in range(40)]
    hits = [(d, v, f"s{d}-{v}-{i}", "AC-2", pick(1)) for d in range(0, 12, 2) for v in (1, 2) for i in (1, 1, 4)]
    questions = [(i, f"How do users review {pick(rng.randint(1, 6))}?") for i in range(30)] + [(100, None), (101, ""), (102, "of it"), (103, "nowhere seen"), (104, "word00 word05 users"), (105, "word00 word05 users")]
    monkeypatch.setattr(coverage, "SEEDS", seeds)
    monkeypatch.setattr(coverage, "BLOCK", block)
    s = spark.createDataFrame(statements, "doc_id long, version_ord int, statement_id string, stmt_ord int, text string, strength string, keywords array<string>, heading_path array<string>")
    h = spark.createDataFrame(hits, "doc_id long, version_ord int, statement_id string, control_id string, title string")
    q = spark.createDataFrame(questions, "question_id long, text string")
    got = {(r.question_id, r["rank"], r.statement_id, r.score) for r in coverage.questionnaire_topk(q, s, h).collect()}
    assert got == _best(questions, statements, hits, 5)
    assert coverage.questionnaire_topk(q.limit(0), s, h).count() == coverage.questionnaire_topk(q, s.limit(0), h).count() == 0
