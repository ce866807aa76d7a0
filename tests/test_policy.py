"""Extraction, changes, infrastructure and monitoring on small cases of our own, and every query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ctrlspark.functions import rules
from ctrlspark.functions.dialect import SPARK
from ctrlspark.operators import extract, iac, impact, monitor
from ctrlspark.plans import queries as policy
from ctrlspark.sources import infra
from ctrlspark.streaming import watch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def statements(spark, text):
    docs = spark.createDataFrame([(1, 1, text)], "doc_id long, version_ord int, markdown string")
    return extract.extract_statements(docs).orderBy("stmt_ord").collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Users must lock their screens.", [("obligation", "must", "positive")]),
        ("Users shall never share passwords.", [("prohibition", "prohibited", "negative")]),
        ("Staff should not reuse tokens.", [("recommendation", "should", "negative")]),
        ("Owners may grant access on request.", [("permission", "may", "positive")]),
        ("Guests need not register twice.", [("permission", "may", "positive")]),
        ("The failure may result in lost data.", []),
        ("The platform may produce telemetry for an account control.", []),
        ("Must users lock their screens?", []),
        ("Accounts are described under AC-2(1) of the catalog.", [("citation", "descriptive", "positive")]),
        ("The firewall is a safeguard of the boundary.", [("control_description", "descriptive", "positive")]),
        ("Admins must disable stale accounts.", [("obligation", "must", "negative")]),
        ("Owners are responsible for backups.", [("responsibility", "must", "positive")]),
    ],
)
def test_classification(spark, text, want):
    assert [(r.statement_kind, r.strength, r.action_polarity) for r in statements(spark, text)] == want


def test_structure(spark):
    text = "# A\n### B\nOne team must\nreview logs. Two teams must review logs.\n### D\nOwners must:\n\n- rotate keys\n- guests must sign in\n\nTail must stay here.\n```\nNobody must read code.\n```\n<!-- Page 7 -->\n| H | R |\n|---|---|\n| x | Logs must be kept; keys must be kept |\n"
    rows = statements(spark, text)
    assert [r.text for r in rows] == ["One team must review logs.", "Two teams must review logs.", "Owners must rotate keys", "guests must sign in", "Tail must stay here.", "x | Logs must be kept", "keys must be kept"]
    assert rows[0].heading_path == ["A", "B"] and rows[2].heading_path == ["A", "B", "D"]
    assert rows[0].page is None and rows[5].page == 7
    assert text[rows[4].span_start : rows[4].span_end] == "Tail must stay here."


def test_clauses(spark):
    got = [r.text for r in statements(spark, "Vendors must sign contracts and staff shall check them, and must be trained; may appeal in writing.")]
    assert got == ["Vendors must sign contracts", "staff shall check them", "must be trained", "may appeal in writing."]
    assert [r.text for r in statements(spark, "Keys must be rotated; logged centrally each day.")] == ["Keys must be rotated", "Keys must be logged centrally each day."]


def test_partitioning_does_not_matter(spark):
    docs = policy.policies(spark, SF).limit(60)
    one, many = (extract.extract_statements(docs.repartition(n)).select("statement_id", "version_ord", "span_start") for n in (1, 7))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_control_ids(spark):
    text = "POL-AC-001 cites ac-3(2) , CC6.1;AC-2,A.5.19 and CIS 5.1"
    got = spark.createDataFrame([(text,)], "t string").select(F.expr(rules.control_ids(SPARK, "t")).alias("ids")).first().ids
    assert got == ["A.5.19", "AC-2", "AC-3", "CC6.1", "CIS5.1"]


@pytest.mark.parametrize(
    ("before", "after", "kind"),
    [
        ("Teams must reply within two days.", "Teams must reply within 24 hours.", "sla_changed"),
        ("Teams must reply immediately.", "Teams must reply within 2 days.", "sla_changed"),
        ("Logs must be kept for one year.", "Logs must be kept for six months.", "retention_weakened"),
        ("Keys must have at least 256 bits.", "Keys must have at least 128 bits.", "threshold_weakened"),
        ("Each owner must test backups.", "Owners must test backups.", "scope_reduced"),
        ("Owners must test backups.", "Owners shall test backups.", "non_material_rewording"),
        ("Owners must not copy data.", "Owners must copy data.", "obligation_reversed"),
        ("Gateways must allow traffic.", "Gateways must deny traffic.", "obligation_reversed"),
        ("Owners must test backups.", "Owners must test backups if possible.", "obligation_softened"),
        ("Owners must test backups.", "Owners must try the backups out.", "obligation_rewritten"),
    ],
)
def test_change_kind(spark, before, after, kind):
    row = impact.change_kinds(spark.createDataFrame([(1, before, after)], "doc_id long, before string, after string")).first()
    assert row.change_kind == kind


def test_pairs_are_one_to_one(spark):
    rows = [(1, 1, 2, f"{c}{i}", i, t, c) for c, ts in (("removed", ["Teams must review logs weekly.", "Teams must review logs."]), ("added", ["Teams must review logs daily.", "Nothing alike stands here at all."])) for i, t in enumerate(ts)]
    diff = spark.createDataFrame(rows, "doc_id long, older int, newer int, statement_id string, stmt_ord long, text string, change string").withColumns({"strength": F.lit("must"), "keywords": F.array(F.lit("logging")), "framework_ids": F.array().cast("array<string>"), "heading_path": F.array(F.lit("A"))})
    changes = impact.verbiage_changes(diff)
    assert sorted(r.change_kind for r in changes.collect()) == ["obligation_added", "obligation_removed", "obligation_rewritten"]


def test_iac_blocks():
    text = '# grc: link_id=a; control_id=AC-2\nresource "t" "one" {\n  x = "} {"\n  y = <<EOT\nresource "no" "no" {\nEOT\n}\n/* resource "t" "gone" {} */\n# resource "t" "two" {\nresource "t" "three" {}\n'
    got = iac.blocks_of(text)
    assert [(b["name"], b["link_id"], b["start_line"]) for b in got] == [("one", "a", 2), ("three", "", 10)]
    assert got[0]["block"].endswith("}") and "EOT" in got[0]["block"]


def test_diff_of_equal_revisions_is_empty(spark):
    res = infra.resources(spark, SF).filter("revision = 1").withColumn("content_hash", F.sha2("body", 256))
    assert iac.iac_diff(res.union(res.withColumn("revision", F.lit(2))), 1, 2).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = watch.as_batch(infra.runs(spark, SF))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.state_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("transitions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = monitor.state_transition(rows).select("monitor_id", "run_id", "transition")
    assert spark.table("transitions").exceptAll(batch).count() == 0 and spark.table("transitions").count() == batch.count()


def test_watch_commits_once(spark, tmp_path):
    docs = policy.policies(spark, SF).limit(40)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has the first one's state and sees nothing new
        watch.watch_documents(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "snapshots")).count() == docs.select("doc_id", "markdown").distinct().count()
    assert spark.read.parquet(str(tmp_path / "out" / "blobs")).count() == docs.select("markdown").distinct().count()


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(policy.QUERIES))
def test_query(spark, checker, name):
    rows = policy.QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect()]
    assert got
    if name in policy.ORACLE_SQL:
        want = checker.sql(policy.ORACLE_SQL[name])
        columns = sorted(want.columns)
        order = [want.columns.index(c) for c in columns]
        assert columns == sorted(rows.columns)
        clean = lambda v: round(v, 9) if isinstance(v, float) else v
        assert sorted(map(repr, (tuple(map(clean, r)) for r in got))) == sorted(map(repr, (tuple(clean(r[i]) for i in order) for r in want.fetchall())))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
