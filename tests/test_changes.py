"""Changes, alerts, watch and notices on cases written by hand, and against slower forms of themselves."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ctrlspark.operators import extract, iac, impact, monitor
from ctrlspark.sources import infra
from ctrlspark.sources.catalogs import catalog
from ctrlspark.streaming import watch

SF = "/root/testdata/sf0.001"
PAIRS = "before string, after string, before_heading string, after_heading string"
CATALOGS = ("scf", "scf_crosswalk", "seed", "ksi", "ksi_words")
SAME = "Accounts must use strong factors."


@pytest.mark.parametrize(
    ("before", "after", "under", "over", "kind"),
    [
        (SAME, SAME, "Access Control", "Identity and Access Control", "non_material_rewording"),
        (SAME, SAME, "Identity and Access Control", "Access Control", "non_material_rewording"),
        (SAME, SAME, "Access Control", "Production Access Control", "obligation_rewritten"),
        (SAME, SAME, "Access Control", "Backups", "obligation_rewritten"),
        (SAME, SAME, "", "Access Control", "obligation_rewritten"),
        (SAME, SAME, "All Systems", "Systems", "scope_reduced"),
        (SAME, SAME, "Systems", "Any Systems", "scope_expanded"),
        (SAME, SAME, "Sites", "Selected Sites", "scope_reduced"),
        ("Owners may grant all access.", "Owners may grant access.", "", "", "obligation_rewritten"),  # the object isn't the subject
        ("Accounts need all factors", "Accounts need factors", "", "", "scope_reduced"),  # no modal: the whole text is looked at
    ],
)
def test_headings_in_change_kinds(spark, before, after, under, over, kind):
    assert impact.change_kinds(spark.createDataFrame([(before, after, under, over)], PAIRS)).first().change_kind == kind


def test_notes(spark):
    rows = [("Owners must test backups.", "Owners must test backups if possible.", "", ""), ("Teams must reply within 2 days.", "Teams must reply within 5 days.", "", ""), ("Owners must test.", "Owners should test within 3 days.", "", "")]
    notes = [r.note for r in impact.change_kinds(spark.createDataFrame(rows, PAIRS)).collect()]
    assert notes == ["The duty became weaker. New exceptions: if possible.", "A deadline or cadence changed. Deadline weakened.", "The duty became weaker."]


DIFF = "doc_id long, older int, newer int, statement_id string, stmt_ord long, text string, strength string, keywords array<string>, framework_ids array<string>, heading_path array<string>, change string"


def differing(seed, docs=3, each=14):
    r = random.Random(seed)
    words = "teams owners must should review rotate encrypt grant revoke log logs keys access within 4 8 hours all backups weekly daily vendors AC-2".split()
    say = lambda: " ".join(r.choice(words) for _ in range(r.randint(3, 9)))
    out = []
    for d in range(docs):
        texts = [say() for _ in range(each)]
        for change in ("removed", "added"):
            for i in range(each):
                t = texts[i].split()
                if r.random() < 0.7:
                    t[r.randrange(len(t))] = r.choice(words)
                out.append((d, 1, 2, f"{change[0]}{i}", i, " ".join(t) if r.random() < 0.8 else say(), "must", r.sample(["a", "b"], 1), [], [r.choice("XY")], change))
    return out


def one_by_one(scored, threshold):
    """The pairs of each version pair by going through all of them, best first."""
    old, new, out = set(), set(), set()
    for r in sorted(scored, key=lambda r: (r.doc_id, -r.score, r.a_stmt_ord, r.b_stmt_ord)):
        a, b = (r.doc_id, r.a_statement_id), (r.doc_id, r.b_statement_id)
        if r.score >= threshold and a not in old and b not in new:
            old.add(a), new.add(b)
            out.add((r.doc_id, r.a_statement_id, r.b_statement_id))
    return out


def test_bound_and_rounds_give_the_same_pairs(spark):
    for seed in (1, 2):
        diff = spark.createDataFrame(differing(seed), DIFF)
        every, near = impact.match_score(diff, 0.0).collect(), impact.match_score(diff, 0.5)
        assert all(r.bound >= r.score for r in every)
        assert near.count() < len(every) == 3 * 14 * 14
        assert all(r.bound >= 0.5 for r in near.collect())
        got = {(r.doc_id, r.a_statement_id, r.b_statement_id) for r in impact.greedy_pairs(near).collect()}
        assert got == one_by_one(every, 0.5) and len(got) > 10
    assert impact.greedy_pairs(near.limit(0)).count() == 0
    text = {(r.a_text, r.b_text) for r in every[:20]}
    assert all(0 <= SequenceMatcher(None, a, b).ratio() <= 1 for a, b in text)


def test_a_chain_of_pairs_takes_a_round_each(spark):
    rows = [(1, 1, 2, f"a{i}", i, f"b{j}", j, "x", "y", [], [], s) for i, j, s in [(0, 0, 0.9), (0, 1, 0.8), (1, 1, 0.85), (1, 0, 0.95), (2, 1, 0.84), (2, 2, 0.6), (3, 2, 0.6)]]
    scored = spark.createDataFrame(rows, "doc_id long, older int, newer int, a_statement_id string, a_stmt_ord long, b_statement_id string, b_stmt_ord long, a_text string, b_text string, a_heading_path array<string>, b_heading_path array<string>, score double")
    got = {(r.a_statement_id, r.b_statement_id) for r in impact.greedy_pairs(scored).collect()}
    assert got == {("a1", "b0"), ("a2", "b1"), ("a3", "b2")} and got == {(a, b) for _, a, b in one_by_one(scored.collect(), 0.5)}


CHANGE = "doc_id long, older int, newer int, before_id string, after_id string, before string, after string, before_strength string, change_kind string, sla string, risk string, note string"


def test_impacts_alerts_and_assessments(spark):
    change = lambda d, i, kind, risk: (d, 1, 2, i, "", "x", "y", "must", kind, "", risk, kind + ".")
    changes = spark.createDataFrame([change(1, "s1", "obligation_softened", "critical"), change(1, "s2", "sla_changed", "info"), change(1, "s3", "obligation_hardened", "low"), change(2, "s4", "non_material_rewording", "info")], CHANGE)
    hits = spark.createDataFrame([(1, "s1", "NIST 800-53", "AC-2"), (1, "s2", "SOC 2", "CC6.1"), (1, "s3", "ISO 27001", "5.15"), (2, "s4", "SOC 2", "CC6.1")], "doc_id long, statement_id string, framework string, control_id string")
    lost = spark.createDataFrame([(1, 1, 2, "CC7.2", "SOC 2")], "doc_id long, older int, newer int, subject string, framework string")
    impacts = impact.framework_impacts(changes, hits, lost)
    assert {(r.doc_id, r.framework, r.controls, r.risk, r.reasons) for r in impacts.collect()} == {(1, "NIST 800-53", "AC-2", "critical", "obligation_softened."), (1, "SOC 2", "CC6.1,CC7.2", "high", "Citation CC7.2 is gone from the document.; sla_changed.")}
    held = spark.createDataFrame([("a", ["FedRAMP KSI"], [], "active"), ("b", ["FedRAMP"], [1], "active"), ("c", ["SOC 2"], [2], "active"), ("d", ["SOC 2"], [], "closed"), ("e", ["ISO 27001", "SOC 2"], [], "active")], "assessment_id string, frameworks array<string>, doc_ids array<long>, status string")
    risks = impact.assessments_at_risk(impacts, held)
    assert {(r.doc_id, r.assessment_id, r.frameworks, r.risk) for r in risks.collect()} == {(1, "a", "FedRAMP KSI", "critical"), (1, "b", "FedRAMP", "critical"), (1, "e", "SOC 2", "high")}
    own = impacts.unionByName(impacts.filter("framework = 'SOC 2'").withColumns({"framework": F.lit("FedRAMP KSI"), "risk": F.lit("low")}))
    assert {(r.assessment_id, r.risk) for r in impact.assessments_at_risk(own, held).filter("assessment_id in ('a', 'b')").collect()} == {("a", "low"), ("b", "medium")}
    duties = spark.createDataFrame([("a", "c", "DOC-1 (Map)", "2 weeks"), ("b", "d", "DOC-2 (Log)", "")], "assessment_id string, class_id string, documents string, cadence string")
    alerts = {r.doc_id: r for r in impact.impact_alerts(changes, impacts, risks, duties).collect()}
    assert (alerts[1].severity, alerts[1].changes, alerts[1].class_id) == ("critical", 3, "d")
    assert alerts[1].summary == "[CRITICAL] pol-1: 3 duties changed; frameworks: NIST 800-53, SOC 2; assessments: a, b, e"
    assert alerts[1].actions[2:] == [impact.ACTIONS[2], "Check coverage again: NIST 800-53, SOC 2", "Tell the owners of: a, b, e", "Keep the documents of class C up to date: DOC-1 (Map); package every 2 weeks.", "Keep the documents of class D up to date: DOC-2 (Log)."]
    assert (alerts[2].severity, alerts[2].summary, len(alerts[2].actions)) == ("info", "[INFO] pol-2: 1 duties changed; frameworks: none; assessments: none", 2)
    only = impact.severity_rollup(changes.filter("doc_id = 2"), impacts.withColumn("doc_id", F.lit(2).cast("long"))).first()
    assert (only.severity, only.changes) == ("critical", 1)  # an impact counts without a change of its own


def policy_text(k, v):
    duty = "should" if v >= 2 and k % 2 else "must"
    when = 4 if v < 3 else 8
    return f"# Access\n\nAdmins {duty} review accounts within {when} hours per AC-2.\n\nLogs must be kept for {6 + (v if k == 3 else 0)} months.\n"


def test_watch_compares_over_batches(spark, tmp_path):
    versions = {v: [(k, v, policy_text(k, v if k else 1)) for k in range(5) if (k, v) != (4, 1)] for v in (1, 2, 3)}
    schema = "doc_id long, version_ord int, markdown string"
    cats = {n: catalog(spark, n) for n in CATALOGS}
    held = spark.createDataFrame([("soc", ["SOC 2", "NIST 800-53"], [], "active")], "assessment_id string, frameworks array<string>, doc_ids array<long>, status string")
    analyse = lambda docs: impact.alerts_between(docs, cats, held)
    for v, rows in versions.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch.watch_documents(stream, str(tmp_path / "out"), str(tmp_path / "state"), analyse).awaitTermination()
        if v == 1:
            assert not (tmp_path / "out" / "alerts").exists()  # first sight is silent
    every = [r for rows in versions.values() for r in rows]
    kept = [r for r in every if r[1] == min(x[1] for x in every if x[0] == r[0]) or r[2] != next(x[2] for x in every if (x[0], x[1]) == (r[0], r[1] - 1))]
    batch = analyse(spark.createDataFrame(kept, schema))
    streamed = spark.read.parquet(str(tmp_path / "out" / "alerts")).drop("batch")
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0 and streamed.count() == batch.count() > 4
    assert {r.doc_id for r in streamed.collect()} == {1, 2, 3, 4}
    snapshots = spark.read.parquet(str(tmp_path / "out" / "snapshots"))
    assert snapshots.count() == len(kept) and snapshots.filter("parent_snapshot_id is null").count() == 5
    assert spark.read.parquet(str(tmp_path / "out" / "blobs")).count() == len({r[2] for r in every})


def log(spark, rows):
    return spark.createDataFrame([(1, i, i, *r) for i, r in enumerate(rows)], "monitor_id long, run_id long, run_ts long, status string, severity string, finding string, input string")


def test_notices_wait_for_delivery(spark):
    runs = log(spark, [
        ("aligned", "info", "", "r0"), ("misaligned", "high", "f", "r1"), ("misaligned", "high", "f", "r1"), ("misaligned", "high", "f", "r1"), ("misaligned", "high", "f", "r2"),
        ("review_required", "low", "g", "r2"), ("aligned", "info", "", "r3"), ("aligned", "info", "", "r3"), ("misaligned", "high", "f", "r2"), ("aligned", "info", "", "r4"),
    ])
    acks = spark.createDataFrame([(1, 1, 1, False), (1, 2, 2, True), (1, 4, 4, True), (1, 6, 6, True), (1, 8, 8, True)], "monitor_id long, run_id long, ts long, delivered boolean")
    got = {r.run_id: (r.event, r.decision) for r in monitor.notify_decision(runs, acks).collect()}
    assert got == {
        0: ("none", "quiet"), 1: ("misaligned", "sent"), 2: ("misaligned", "sent"), 3: ("misaligned", "suppressed"), 4: ("misaligned", "sent"), 5: ("none", "quiet"),
        6: ("recovered", "sent"), 7: ("none", "quiet"), 8: ("misaligned", "sent"), 9: ("recovered", "sent"),
    }
    states = {r.run_id: r.state for r in monitor.outbox(monitor.notify_decision(runs, acks), acks).collect()}
    assert states == {1: "failed", 2: "delivered", 4: "delivered", 6: "delivered", 8: "delivered", 9: "pending"}
    never = monitor.notify_decision(log(spark, [("misaligned", "high", "f", "r"), ("aligned", "info", "", "r")]), acks.limit(0))
    assert {r.run_id: r.decision for r in never.collect()} == {0: "sent", 1: "quiet"}  # no recovery without a delivered notice
    loud = monitor.notify_decision(runs, acks, threshold="low", on_recovery=False)
    assert {r.run_id for r in loud.filter("event = 'recovered'").collect()} == set() and loud.filter("run_id = 5").first().decision == "sent"


def test_notices_of_stream_and_batch(spark, tmp_path):
    runs, acks = infra.runs(spark, SF), infra.outcomes(spark, SF)
    rows = watch.monitor_log(runs, acks)
    ordered = rows.withColumn("part", F.ntile(3).over(Window.orderBy("ts", "run_id", "is_outcome")))
    for k in (1, 2, 3):  # three batches, in order of time
        ordered.filter(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = watch.notify_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    out, batch = spark.read.parquet(str(tmp_path / "out")), monitor.notify_decision(runs, acks)
    batch = batch.select(F.col("monitor_id").cast("long"), F.col("run_id").cast("long"), "event", "decision")
    assert out.count() == batch.count() and out.select(*batch.columns).exceptAll(batch).count() == 0
    assert {r.decision for r in batch.select("decision").distinct().collect()} == {"quiet", "sent", "suppressed"}


# --- infrastructure ---------------------------------------------------------
HEREDOC = 'resource "null_resource" "a" {\n  run = <<-EOF-\nnot one\n  x = <<EOF\nencrypted = false\n0.0.0.0/0 } {\n  EOF\n}\n'


def test_heredocs_and_comments_are_no_configuration(spark):
    text = 'resource "null_resource" "c" {\n  # encrypted = false\n  # tags = { link_id = "ghost" }\n  v = "safe"\n}\n\nresource "null_resource" "s" {\n  command = << EOF_1 | more\n# grc: link_id=ghost; control_ids=AC-2\nencrypted = false\n0.0.0.0/0 } {\nEOF_1\n}\n\nresource "null_resource" "open" {\n  v = <<EOF\nencrypted = false\n'
    files = spark.createDataFrame([("r", 1, "m/main.tf", text)], "repository string, revision int, relative_path string, content string")
    rows = iac.iac_classify(iac.iac_extract(files)).orderBy("start_line").collect()
    assert [(r.name, r.start_line) for r in rows] == [("c", 1), ("s", 7), ("open", 15)]
    for r in rows:
        assert (r.tags, r.annotations, r.security_sensitive, r.posture, r.status) == ({}, {}, False, "unknown", "not_security_relevant"), r.name
        assert text[r.span_start : r.span_end].strip() == r.block
    real = iac.iac_classify(spark.createDataFrame([("aws_ebs_volume", 'note = "<<EOF # no"\nencrypted = false', {}, {})], "resource_type string, block string, annotations map<string,string>, tags map<string,string>")).first()
    assert real.posture == "violated"  # a mark inside a string opens nothing


def test_text_outside_resources(spark):
    def file(default, size, more=""):
        return f'variable "x" {{\n  default = {default}\n}}\nresource "t" "a" {{\n  n = {size}\n}}\n{more}'

    old = {"same.tf": file(1, 1), "inside.tf": file(1, 1), "mixed.tf": file(1, 1), "beside.tf": file(1, 1), "blank.tf": file(1, 1), "x.tfvars": "a = 1", "gone.json": "{}", "read.me": "1"}
    new = {"same.tf": file(1, 1), "inside.tf": file(1, 2), "mixed.tf": file(2, 2), "beside.tf": file(2, 1), "blank.tf": file(1, 1, "\n\n").replace("n = 1", "n = 3"), "x.tfvars": "a = 2", "came.yaml": "", "read.me": "2"}
    rows = [("r", v, p, t) for v, side in ((1, old), (2, new)) for p, t in side.items()]
    files = spark.createDataFrame(rows, "repository string, revision int, relative_path string, content string")
    got = {(r.relative_path, r.change, r.mixed) for r in iac.unclassified_file_change(files, iac.iac_extract(files), 1, 2).collect()}
    assert got == {("mixed.tf", "changed", True), ("beside.tf", "changed", False), ("x.tfvars", "changed", False), ("gone.json", "removed", False), ("came.yaml", "added", False)}


def test_many_resources_in_one_file_take_linear_time():
    def seconds(n):
        text = "".join(f'# grc: link_id=l{i}\nresource "t" "r{i}" {{\n  a = {{ b = "{{" }}\n}}\n' for i in range(n))
        start = time.perf_counter()
        assert len(iac.blocks_of(text)) == n
        return time.perf_counter() - start

    assert seconds(16_000) < 12 * max(seconds(4_000), 0.05)


def test_long_documents_split_in_linear_time(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, 1, "line of a text\r\n" * n)], "doc_id long, version_ord int, markdown string")
        start = time.perf_counter()
        assert extract.lines_explode(docs).agg(F.max("offset")).first()[0] == 16 * n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 8 * max(seconds(4_000), 0.5)


def test_assessments_for_all_documents_are_judged_by_class(spark):
    impacts = spark.createDataFrame([(d, 1, 2, f, r) for d in range(40) for f, r in (("NIST 800-53", "high"), ("SOC 2", "low" if d % 2 else "critical"), ("FedRAMP KSI", "info")) if (d % 3 or f != "FedRAMP KSI") and (d % 5 or f != "SOC 2")], "doc_id long, older int, newer int, framework string, risk string")
    rows = [(f"all{i}", [["SOC 2"], ["FedRAMP", "NIST 800-53"], ["FedRAMP KSI"], ["PCI DSS"]][i % 4], [], "active" if i % 7 else "closed") for i in range(60)]
    rows += [("one", ["SOC 2", "FedRAMP"], [3, 9, 3], "active"), ("both", ["SOC 2"], [], "active"), ("both", ["NIST 800-53"], [4, 6], "active"), ("null", ["SOC 2"], None, "active"), ("none", [], [], "active")]
    held = spark.createDataFrame(rows, "assessment_id string, frameworks array<string>, doc_ids array<long>, status string")
    by_class = impact.risk_classes(impacts, held)
    assert by_class.by_class.count() < 40 * 4 and by_class.classes.count() == 4
    ranks, want = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}, {}
    names = {v: k for k, v in ranks.items()}
    told = impacts.collect()
    for doc in range(40):
        own = {r.framework: ranks[r.risk] for r in told if r.doc_id == doc}
        reached = own | ({"FedRAMP": 2 if "FedRAMP KSI" in own else own["NIST 800-53"]} | ({} if "FedRAMP KSI" in own else {"FedRAMP KSI": own["NIST 800-53"]}) if "NIST 800-53" in own else {})
        for i, fs, docs, status in rows:
            met = [f for f in fs if f in reached] if status == "active" and docs is not None and (not docs or doc in docs) else []
            if met:
                names_, worst = want.get((doc, i), (set(), 0))
                want[doc, i] = (names_ | set(met), max(worst, *(reached[f] for f in met)))
    got = impact.assessments_at_risk(impacts, held)
    assert sorted((r.doc_id, r.assessment_id, r.frameworks, r.risk) for r in got.collect()) == sorted((*k, ",".join(sorted(f)), names[r]) for k, (f, r) in want.items())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("Union")[1].split("Exchange hashpartitioning")[0]  # the product of pairs and assessments is not shuffled
    changes = spark.createDataFrame([(d, 1, 2, "s", "", "x", "y", "must", "obligation_softened", "", "medium", "n.") for d in range(40)], CHANGE)
    duties = spark.createDataFrame([("all1", "c", "DOC-1", ""), ("all5", "b", "DOC-2", ""), ("one", "d", "DOC-3", "")], "assessment_id string, class_id string, documents string, cadence string")
    ours, plain = impact.impact_alerts(changes, impacts, by_class, duties), impact.impact_alerts(changes, impacts, got, duties)
    assert ours.count() == 40 and ours.exceptAll(plain).count() == plain.exceptAll(ours).count() == 0
    whole = {r.doc_id: r.actions for r in ours.collect()}
    assert all(f"Tell the owners of: {', '.join(sorted(i for k, i in want if k == d))}" in whole[d] for d in whole)


def test_impacts_map_the_statements_that_changes_touch(spark):
    changes = spark.createDataFrame([(1, 1, 2, "a", "b", "x", "y", "must", "obligation_softened", "", "high", "n."), (1, 1, 2, "", "c", "", "y", "must", "obligation_added", "", "low", "n."), (2, 1, 2, "d", "e", "x", "y", "must", "non_material_rewording", "", "info", "n.")], CHANGE)
    statements = spark.createDataFrame([(1, v, i) for v in (1, 2) for i in "abcd"] + [(2, 1, "d"), (2, 1, "a")], "doc_id long, version_ord int, statement_id string")
    assert sorted(map(tuple, impact.touched(statements, changes).select("doc_id", "version_ord", "statement_id").collect())) == [(1, v, i) for v in (1, 2) for i in "ac"]


def test_changes_are_judged_once_a_pair_of_texts(spark):
    texts = [("Owners must rotate keys within 24 hours.", "Owners should rotate keys within 48 hours.", "All Systems", None), ("Owners must rotate keys.", None, None, ""), (None, None, None, None), ("Staff may report.", "Staff must not report.", "", "Scope")]
    pairs = spark.createDataFrame([(n, *texts[n % 4]) for n in range(40)], "n int, before string, after string, before_heading string, after_heading string")
    assert impact.change_kinds(pairs)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    plain = pairs.fillna("", ["before_heading", "after_heading"])
    whole = impact._judged(plain.withColumn("k", F.col("n"))).drop("k")
    for few, join in ((impact.FEW, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        found = impact.change_kinds(pairs, few)
        assert join in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 40 and found.select(*whole.columns).exceptAll(whole).count() == 0
    judged = impact.staged(impact._judged(plain.drop("n").distinct()), "texts")
    assert judged.count() == 4
