"""Resources, links and registries on cases with expected values written by hand."""

import json

import random

import pytest
from pyspark.sql import functions as F

from ctrlspark.functions import change_rules
from ctrlspark.operators import coverage, evaluate, extract, iac, impact, monitor, reconcile, registry

RESOURCE = "resource_type string, block string, annotations map<string,string>, tags map<string,string>"


def classified(spark, kind, block="", annotations=None, tags=None):
    df = spark.createDataFrame([(kind, block, annotations or {}, tags or {})], RESOURCE)
    r = iac.iac_classify(df).first()
    return r


@pytest.mark.parametrize(
    ("kind", "block", "notes", "want"),
    [
        ("aws_iam_role", "", {}, (["access_control"], ["AC-2", "AC-3", "IA-2"], ["preventive"], True, 0.82, "unknown", "review_required")),
        ("aws_iam_role", 'assume_role = "x"', {}, (["access_control"], ["AC-2", "AC-3", "IA-2"], ["preventive"], True, 0.9, "implemented", "classified")),
        ("null_resource", "", {}, ([], [], [], False, 0.0, "unknown", "not_security_relevant")),
        ("null_resource", "", {"control_ids": "ac-2, ksi-iam-01"}, ([], ["AC-2", "KSI-IAM-01"], [], True, 0.99, "implemented", "reviewed_annotation")),
        ("null_resource", "", {"control_id": "nonsense"}, ([], [], [], True, 0.5, "review_required", "review_required")),
        ("null_resource", "", {"domains": "IAM|Cryptography"}, (["access_control", "encryption"], [], [], True, 0.98, "implemented", "reviewed_annotation")),
        ("null_resource", "", {"link_id": "x"}, ([], [], [], True, 0.97, "implemented", "classified")),
        ("null_resource", 'x = ["0.0.0.0/0"]', {}, (["network_security"], ["AC-4", "SC-7"], ["exposure", "preventive"], True, 0.92, "review_required", "review_required")),
        ("null_resource", 'x = ["0.0.0.0/0"]', {"posture": "Approved"}, (["network_security"], ["AC-4", "SC-7"], ["exposure", "preventive"], True, 0.92, "implemented", "classified")),
        ("aws_ebs_volume", "encrypted  =  false", {"roles": "Detective"}, (["encryption"], ["SC-12", "SC-13", "SC-28"], ["configuration_risk"], True, 0.98, "violated", "misconfigured")),
        ("aws_ebs_volume", "# encrypted = false", {}, ([], [], [], False, 0.0, "unknown", "not_security_relevant")),
    ],
)
def test_iac_classify(spark, kind, block, notes, want):
    r = classified(spark, kind, block, notes)
    assert (r.domains, r.control_ids, r.roles, r.security_sensitive, r.confidence, r.posture, r.status) == want


def test_nulls_in_resources(spark):
    r = iac.iac_classify(spark.createDataFrame([(None, None, None, None)], RESOURCE)).first()
    assert (r.domains, r.status) == ([], "not_security_relevant")
    r = classified(spark, "null_resource", tags={"grc_domain": "cookery", "link_id": "a"})
    assert r.unknown_domains == ["cookery"] and r.confidence == 0.98


def test_control_id_shapes(spark):
    ids = {"AC-2": True, "ac-2(1)": True, "IAC-15.1": True, "KSI-IAM-01": True, "CC6.1": True, "CC6": False, "A.5.15": True, "8.24": True, "8": False, "PR.AA-01": True, "PR.DS": True, "CIS 5.1": True, "Req. 3": True, "XX-1": False, "AC-2 x": False, "": False}
    df = spark.createDataFrame([(i,) for i in ids], "c string").select("c", iac.control_id_valid(F.col("c")).alias("v"))
    assert {r.c: r.v for r in df.collect()} == ids


def test_annotations_and_tags():
    assert iac.annotations_of('# grc: Link_ID = "a"; control_ids=AC-2|SC-7, x=\n// GRC: posture=approved') == {"link_id": "a", "control_ids": "AC-2|SC-7", "posture": "approved"}
    assert iac.tags_of('tags = {\n Name = "n"\n "grc_domain" = "iam"\n other = "x"\n}\ncontrol_id = "AC-9"') == {"Name": "n", "grc_domain": "iam"}
    assert iac.tags_of('control_id = "AC-9"') == {"control_id": "AC-9"}


LINK = "link_id string, doc_id long, anchor string, keywords array<string>, expected_domains array<string>, expected_kind string, expected_strength string, expected_polarity string, addresses array<string>, types array<string>, paths array<string>, repositories array<string>"


def link(i, **more):
    row = {"anchor": "encrypt", "keywords": [], "expected_domains": ["encryption"], "expected_kind": None, "expected_strength": None, "expected_polarity": None, "addresses": [], "types": [], "paths": [], "repositories": []} | more
    return (i, 1, *row.values())


def test_links_and_gaps(spark):
    links = spark.createDataFrame([link("a"), link("b", anchor="zz", keywords=["BACKUP", "media"], addresses=["t.x"]), link("c", anchor="nowhere"), link("d", addresses=["m1::t.x"]), link("e", types=["t"], paths=["m2/"], repositories=["r2"])], LINK)
    statements = spark.createDataFrame([(1, 2, "s1", 0, "h1", "Encrypt it all"), (1, 2, "s2", 1, "h2", "Backup of media"), (1, 2, "s3", 2, "h3", "encrypt again")], "doc_id long, version_ord int, statement_id string, stmt_ord int, content_hash string, text string")
    matched = reconcile.link_statement(links, statements)
    assert {r.link_id: r.statement_id for r in matched.collect()} == {"a": "s1", "b": "s2", "d": "s1", "e": "s1"}
    resources = spark.createDataFrame([("r1", 2, "m1", "t.x", "t", "m1/main.tf", ""), ("r2", 2, "m2", "t.x", "t", "m2/main.tf", ""), ("r2", 2, "m3", "t.y", "t", "m3/main.tf", "ghost")], "repository string, revision int, module_path string, address string, resource_type string, relative_path string, link_id string")
    wired = reconcile.link_resources(links, resources)
    assert {(r.link_id, r.repository, r.address) for r in wired.collect()} == {("b", "r1", "t.x"), ("b", "r2", "t.x"), ("d", "r1", "t.x"), ("e", "r2", "t.x")}
    gaps = {(r.link_id, r.kind, r.severity, r.iac_ref) for r in reconcile.completeness_gaps(links, matched, wired, resources).collect()}
    assert gaps == {("a", "missing_iac_implementation", "critical", ""), ("b", "ambiguous_iac_selector", "critical", "r1::m1::t.x, r2::m2::t.x"), ("c", "missing_policy_statement", "high", ""), ("d", "covered", "info", ""), ("e", "covered", "info", ""), ("", "orphan_iac_annotation", "medium", "r2::m3::t.y")}
    older = matched.filter("link_id in ('a', 'b')").unionByName(spark.createDataFrame([("c", 1, 1, "s0", "h0")], "link_id string, doc_id long, version_ord int, statement_id string, content_hash string")).withColumn("content_hash", F.when(F.col("link_id") == "a", "h1").otherwise("old"))
    docs = reconcile.doc_change_gaps(links, older, matched, wired)
    assert {(r.link_id, r.kind, r.severity) for r in docs.collect()} == {("a", "policy_without_iac", "high"), ("b", "policy_obligation_changed_verify_iac", "high"), ("c", "policy_obligation_removed_iac_still_present", "critical")}
    delta = spark.createDataFrame([("r1", "m1", "t.x", "removed", "", "t"), ("r3", "m", "aws_iam_role.q", "added", "", "aws_iam_role"), ("r3", "m", "t.q", "added", "", "t")], "repository string, module_path string, address string, change string, link_id string, resource_type string")
    code = reconcile.iac_change_gaps(delta, links, wired, resources.limit(0), matched.filter("link_id <> 'd'"))
    assert {(r.link_id, r.kind, r.severity) for r in code.collect()} == {("b", "iac_removed_requires_doc_review", "critical"), ("d", "iac_removed_requires_doc_review", "critical"), ("d", "doc_anchor_missing_after_iac_change", "critical"), ("", "unlinked_sensitive_iac_change", "high")}
    every = reconcile.change_set(code, docs, reconcile.completeness_gaps(links, matched, wired, resources))
    assert {(r.link_id, r.severity) for r in every.filter("kind like 'coordinated%'").collect()} == {("b", "critical")}
    assert every.filter("kind = 'coordinated_control_retirement_review'").count() == 1 and every.filter("kind = 'ambiguous_iac_selector'").count() == 1


def test_anchors_and_risks(spark):
    links = spark.createDataFrame([("a", 1, "Admins must review accounts per AU-2.", ["AC-2", "AU-2"]), ("b", 1, "no duty at all", ["SC-28"]), ("c", 2, "nothing", None)], "link_id string, doc_id long, anchor string, control_ids array<string>")
    got = {r.statement_id: (r.doc_id, r.framework_ids, r.keywords, r.confidence > 0) for r in reconcile.anchor_statements(links).collect()}
    assert got == {"a": (1, ["AU-2", "AC-2"], ["access_control"], True), "b": (1, ["SC-28"], [], False), "c": (2, [], [], False)}
    held = spark.createDataFrame([link("a"), link("b")], LINK)
    of = lambda h: spark.createDataFrame([(i, 1, 1, f"s{i}", h + i) for i in "ab"], "link_id string, doc_id long, version_ord int, statement_id string, content_hash string")
    changes = spark.createDataFrame([("sa", "critical"), ("sa", "low"), ("sb", "medium"), ("", "critical")], "before_id string, risk string")
    wired = spark.createDataFrame([], "link_id string, repository string, module_path string, address string")
    assert {r.link_id: r.severity for r in reconcile.doc_change_gaps(held, of("x"), of("y"), wired, changes).collect()} == {"a": "critical", "b": "high"}
    resources = spark.createDataFrame([("r", 1, "m", "t.x", True, 0.9), ("r", 1, "m", "t.y", True, 0.8), ("r", 1, "m", "t.z", False, 0.9)], "repository string, revision int, module_path string, address string, security_sensitive boolean, confidence double")
    alone = reconcile.unlinked_sensitive(resources, wired.withColumn("revision", F.lit(1)))
    assert {(r.address, r.severity) for r in alone.collect()} == {("t.x", "high"), ("t.y", "medium")}


def test_alignment(spark):
    links = spark.createDataFrame([link("a", expected_domains=["iam", "encryption"], expected_strength="must"), link("b", expected_domains=[])], LINK)
    matched = spark.createDataFrame([("a", 1, 2, "s"), ("b", 1, 2, "s")], "link_id string, doc_id long, version_ord int, statement_id string")
    statements = spark.createDataFrame([(1, 2, "s", ["encryption", "backup"], "obligation", "should", "positive", 0.8)], "doc_id long, version_ord int, statement_id string, keywords array<string>, statement_kind string, strength string, action_polarity string, confidence double")
    resources = spark.createDataFrame([("r", 2, "m", "t.x", ["access_control"], "violated", 0.9), ("r", 2, "m", "t.y", ["logging"], "unknown", 0.5)], "repository string, revision int, module_path string, address string, domains array<string>, posture string, confidence double")
    wired = resources.select(F.lit("a").alias("link_id"), "repository", "revision", "module_path", "address")
    rows = {(r.link_id, r.kind, r.iac_ref) for r in reconcile.alignment_gaps(links, matched, statements, wired, resources, exact=True).collect()}
    both = "r::m::t.x, r::m::t.y"
    assert rows == {
        ("b", "classifier_ground_truth_missing", ""), ("a", "policy_classifier_review_required", ""), ("a", "policy_statement_semantic_mismatch", ""), ("a", "policy_classifier_domain_mismatch", ""),
        ("a", "policy_classifier_unexpected_domain", ""), ("a", "terraform_classifier_domain_mismatch", both), ("a", "terraform_classifier_unexpected_domain", both), ("a", "terraform_control_violation", "r::m::t.x"),
        ("a", "terraform_posture_review_required", "r::m::t.y"), ("a", "terraform_classifier_review_required", "r::m::t.y"),
    }


@pytest.mark.parametrize(
    ("before", "after", "kind", "sla"),
    [
        ("Report within 2 days and review within 3 days.", "Report within 2 days and review within 5 days.", None, "weakened"),
        ("Teams must report within two weeks.", "Teams must report within one week.", "sla_changed", "tightened"),
        ("Teams must report within 1 year.", "Teams must report within 2 years.", "obligation_rewritten", ""),
        ("Owners must encrypt data.", "Data must be encrypted by owners.", "non_material_rewording", ""),
        ("Users must not share any passwords.", "Users must not share passwords.", "non_material_rewording", ""),
        ("Staff must rotate keys.", "Staff must rotate keys except during freezes.", "obligation_softened", ""),
        ("Keys must be rotated.", "Keys must be rotated if managers approve it.", "obligation_softened", ""),
        ("Access is prohibited.", "Access must be logged.", "obligation_reversed", ""),
    ],
)
def test_changes_by_hand(spark, before, after, kind, sla):
    r = impact.change_kinds(spark.createDataFrame([(before, after)], "before string, after string")).first()
    assert r.sla == sla and kind in (None, r.change_kind), r


def test_line_ends_and_tabs(spark):
    text = "# A\r\n\t```\r\ncode must\r\n\t```\r\nlast\nend"
    rows = extract.fence_filter(extract.lines_explode(spark.createDataFrame([(1, 1, text)], "doc_id long, version_ord int, markdown string"))).orderBy("line_ord").collect()
    assert all(text[r.offset :].startswith(r.line) for r in rows)
    assert [r.kind for r in rows if r.kind != "fenced"] == ["heading", "fence", "fence", "prose", "prose"]


def test_heading_paths_at_odd_levels(spark):
    """Headings that begin deep, skip levels and come back, against a plain fold."""
    rng = random.Random(5)
    docs = [(d, 1, "\n".join(f"{'#' * rng.randint(1, 6)} T{i}" if rng.random() < 0.7 else f"line {i}" for i in range(60))) for d in range(8)] + [(90, 1, "### deep\n### deep again\n### and again\nx\n# top\ny"), (91, 1, "no heading"), (92, 1, "")]
    rows = extract.heading_path(extract.page_fill(extract.fence_filter(extract.lines_explode(spark.createDataFrame(docs, "doc_id long, version_ord int, markdown string"))))).collect()
    got = {(r.doc_id, r.line_ord): r.heading_path for r in rows}
    for doc, _, text in docs:
        path = []
        for i, line in enumerate(text.split("\n")):
            if line.startswith("#"):
                marks, name = line.split(" ", 1)
                path = [*path[: len(marks) - 1], name]
            assert got[(doc, i)] == path, (doc, i)


def test_questions_by_both_ways(spark, monkeypatch):
    key = "doc_id long, version_ord int, statement_id string, stmt_ord int, text string, strength string, keywords array<string>, heading_path array<string>"
    statements = spark.createDataFrame([(1, 1, "a", 0, "Review accounts", "must", [], []), (1, 1, "b", 1, "Reviewed backup", "may", ["backup"], ["Media"])], key)
    hits = spark.createDataFrame([(1, 1, "a", "AC-2", "Account")], "doc_id long, version_ord int, statement_id string, control_id string, title string")
    questions = spark.createDataFrame([(1, "Do you review backup media?"), (2, "Do you review backup media?"), (3, "account")], "question_id long, text string")
    want = {(1, 1, "b", 3.05), (1, 2, "a", 1.45), (2, 1, "b", 3.05), (2, 2, "a", 1.45), (3, 1, "a", 1.45)}
    for most in (2000, 1):
        monkeypatch.setattr(coverage, "VOCABULARY", most)
        assert {(r.question_id, r["rank"], r.statement_id, r.score) for r in coverage.questionnaire_topk(questions, statements, hits).collect()} == want


def test_registries(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name in ("a.md", "b.TXT", "c.pdf"):
        (tmp_path / "docs" / name).write_text("Text é")
    docs = {r.path.rsplit("/", 1)[1]: (r.markdown, r.error) for r in registry.scan_documents(spark, str(tmp_path / "docs")).collect()}
    assert docs == {"a.md": ("Text é", None), "b.TXT": ("Text é", None), "c.pdf": (None, "unsupported suffix")}
    rows = [{"link_id": "a", "doc_id": "p", "statement_anchor": "x", "expected_domains": ["IAM", "Audit Logging"]}, {"link_id": "b"}]
    for name, body in (("bare.json", rows), ("under.json", {"schema_version": 1, "links": rows})):
        (tmp_path / name).write_text(json.dumps(body, indent=1))
        got = registry.load_links(spark, str(tmp_path / name)).orderBy("link_id").collect()
        assert [r.link_id for r in got] == ["a", "b"] and got[0].expected_domains == ["access_control", "logging"] and got[1].expected_domains is None
    (tmp_path / "asm.json").write_text(json.dumps({"assessments": [{"assessment_id": "x", "frameworks": ["SOC 2"], "status": "active"}, {"assessment_id": "y", "status": "closed"}]}))
    held = registry.load_assessments(spark, str(tmp_path / "asm.json"))
    assert [r.assessment_id for r in registry.active_assessments(held).collect()] == ["x"]
    assert {(r.assessment_id, r.status) for r in registry.upsert_assessments(held, held.filter("assessment_id = 'y'").withColumn("status", F.lit("active"))).collect()} == {("x", "active"), ("y", "active")}
    alerts = spark.createDataFrame([("1", 1, 1, 2, "high", "s"), ("2", 1, 1, 2, "low", "s"), ("3", 1, 1, 2, None, "s")], "alert_id string, doc_id long, older int, newer int, severity string, summary string")
    for _ in range(2):
        registry.append_alerts(alerts, str(tmp_path / "alerts"))
    assert registry.read_alerts(spark.read.json(str(tmp_path / "alerts")), "medium").count() == 2 and registry.read_alerts(alerts).count() == 3
    assert registry.alert_index(alerts).columns == ["alert_id", "doc_id", "older", "newer", "severity"]
    registry.write_csv(alerts, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    registry.write_reports(alerts, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_catalogs(spark):
    by = {"b": {"statement": "**Optional:** do", "force": "MUST"}, "c": {"statement": "Do", "force": "SHOULD"}}
    rules = {"KSI": {"X": {"short_name": "IAM", "indicators": {"K1": {"name": "n", "controls": ["ac-2.1", "ia-5", "odd"], "varies_by_class": by}, "K2": {"name": "m", "statement": "s"}}}}}
    got = {r.ksi_id: (r.domain, r.controls, r.a, r.b, r.c, r.d) for r in registry.catalog_flatten(spark.createDataFrame([(json.dumps(rules),)], "value string")).collect()}
    assert got == {"K1": ("IAM", "AC-2(1),IA-5,ODD", "optional", "optional", "should", "required"), "K2": ("IAM", "", *["applicable"] * 4)}
    titles = {"catalog": {"groups": [{"controls": [{"id": "ac-2", "title": "Accounts", "controls": [{"id": "ac-2.1", "title": "More"}]}, {"id": "ac-3", "title": "Rules"}]}]}}
    assert {(r.control_id, r.title) for r in registry.control_titles(spark.createDataFrame([(json.dumps(titles),)], "value string")).collect()} == {("AC-2", "Accounts"), ("AC-2.1", "More"), ("AC-3", "Rules")}


def test_notices_and_cases(spark):
    gaps = spark.createDataFrame([("t", "k", s, "l", str(i)) for i, s in enumerate(["low", "critical", "low"])], "target string, kind string, severity string, link_id string, iac_ref string")
    assert monitor.notification_payload(gaps, "target", 2).first()[1:] == (3, "critical|k|l|1\nlow|k|l|0")
    named = monitor.notification_payload(gaps, "target", 1, spark.createDataFrame([("t", "misaligned"), ("u", "recovered")], "target string, event string"))
    assert {tuple(r) for r in named.collect()} == {("t", "misaligned", 3, "critical|k|l|1"), ("u", "recovered", 0, "")}
    one, two = (monitor.finding_fingerprint(g, "target").first().fingerprint for g in (gaps, gaps.orderBy(F.desc("iac_ref"))))
    assert one == two
    want = spark.createDataFrame([("s", "1", {"a": "x", "b": "y"}), ("s", "2", {"a": "x"}), ("s", "3", {"a": "x"})], "suite string, case_id string, values map<string,string>")
    have = spark.createDataFrame([("1", {"a": "x", "b": "z"}), ("2", {"a": "x", "c": "q"})], "case_id string, values map<string,string>")
    assert {(r.case_id, r.failed, r.passed) for r in evaluate.eval_cases(want, have).collect()} == {("1", "b", False), ("2", "", True), ("3", "a", False)}


def test_ranks_are_the_given_ones():
    assert change_rules.STRENGTH_RANK == {"prohibited": 5, "must": 5, "shall": 5, "should": 3, "may": 1, "descriptive": 0}


def test_links_of_one_selection_share_its_resources(spark):
    many = [link(f"t{i}", types=["t"], paths=["m2/", "nowhere"], repositories=["r2"] if i % 3 == 0 else []) for i in range(300)]
    links = spark.createDataFrame([*many, link("n", addresses=["t.a5"]), link("u", types=["none"], paths=["m2/"]), link("twice", types=["t"], paths=["m2/"]), link("twice", types=["t"], paths=["m1/"])], LINK)
    schema = "repository string, revision int, module_path string, address string, resource_type string, relative_path string, link_id string"
    rows = [(f"r{i % 3}", v, f"m{i % 4}", f"t.a{i}", "t" if i % 5 else "s", f"m{i % 4}/main.tf", {7: "t1", 10: "t3", 14: "t4"}.get(i, "")) for i in range(60) for v in (1, 2) if (i + v) % 11]
    resources = spark.createDataFrame(rows, schema)
    wired = reconcile.wired_resources(links, resources)
    assert wired.members.count() == 300 and wired.chosen.select("selection").distinct().count() == 4 and wired.own.filter("link_id like 't_'").count() <= 6
    of = {}
    for r in links.collect():
        for repository, revision, module, address, kind, path, declared in rows:
            if (declared == r.link_id or address in r.addresses or (not r.addresses and kind in r.types and any(p in path for p in r.paths))) and (not r.repositories or repository in r.repositories):
                of.setdefault(r.link_id, set()).add((repository, revision, module, address))
    got = reconcile.link_resources(links, resources)
    assert sorted(tuple(r) for r in got.select("link_id", "repository", "revision", "module_path", "address").collect()) == sorted((i, *x) for i, xs in of.items() for x in xs)


def test_control_rollup_lists_statements_as_first_seen(spark):
    hit = lambda d, v, n, i, source, k, title, c: (d, v, i, n, source, k, "F", "C", title, c)
    hits = spark.createDataFrame([hit(1, 1, 1, "b", "scf", 2, "", 0.5), hit(1, 1, 2, "a", "seed", 1, "Zeta", 0.75), hit(1, 2, 1, "a", "scf", 1, "Beta", 0.9), hit(1, 2, 2, "c", "scf", 1, "", 0.2), hit(2, 1, 1, "d", "ksi", 1, "Alpha", 0.1)],
        "doc_id long, version_ord int, statement_id string, stmt_ord long, source string, hit_ord long, framework string, control_id string, title string, confidence double")
    said = {"a": ("must", "Do a"), "b": ("may", "Do b"), "c": ("should", "Do c"), "d": ("shall", "Do d")}
    statements = hits.select("doc_id", "version_ord", "statement_id").distinct().join(spark.createDataFrame([(i, x, t, "obligation", 0.8) for i, (x, t) in said.items()], "statement_id string, strength string, text string, statement_kind string, confidence double"), "statement_id")
    about = ("F", "C", "Zeta", "ksi;scf;seed", "0.900", 4)
    assert sorted(map(tuple, coverage.control_rollup(hits, statements).collect())) == [(*about, 1, "b;a;c", "may;must;should", "obligation;obligation;obligation", "0.80;0.80;0.80", "Do b | Do a | Do c"), (*about, 2, "d", "shall", "obligation", "0.80", "Do d")]
