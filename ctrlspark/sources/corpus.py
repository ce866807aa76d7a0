"""A policy corpus derived from the given tables.

The tables hold no policy language, so every row of ``documents`` becomes a policy
in two versions, written by rules over its own columns.  The expressions are
valid in both engines; each version's text has headings, page markers, bullets
under a lead, a fence, a table, wrapped prose, citations and metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TITLES = ("Access Control Policy", "Data Handling Policy", "Operations Policy", "Supplier Policy", "Incident Policy")
SENTENCES = (
    "The ' || source || ' team must review privileged access every quarter and revoke stale accounts.",
    "Administrators shall encrypt backup media with approved cryptography per SC-28 and CP-9.",
    "Operators should not share passwords with vendors.",
    "Shared accounts are prohibited on ' || source || ' systems.",
    "Managers may approve temporary access for visitors.",
    "The security office is responsible for incident response under IR-4.",
    "Contractors need not complete awareness training twice.",
    "The service may generate telemetry when a device restarts.",
    "Logs must be retained for at least ' || months || ' months, and must be encrypted at rest.",
    "Vendors must not store personal data; suppliers shall report a breach within ' || hours || ' hours.",
    "The audit trail is required to cover network boundary devices (AU-2, CC7.2).",
    "Each facility has to escort visitors and staff must wear a badge.",
    "This standard describes firewall segmentation as a safeguard.",
    "The control aligns with ISO 27001:2013 and NIST CSF 1.1 guidance on risk assessment procedure.",
    "See 800-53 Rev 4 control AC-2(1) for the account management procedure.",
    "All changes will document the configuration baseline within ' || hours || ' hours.",
    "Teams must disable unused accounts immediately.",
    "Can a vendor access the network without approval?",
    "Reviewers shall check supplier contracts for PR.DS-11, A.5.19 and CIS 5.1 annually.",
    "Weather on the ' || lang || ' site is mild in spring.",
)
BULLETS = ("rotate keys monthly", "record each incident in the log", "report weakness reports to the ' || source || ' desk", "visitors must sign in", "keep asset inventory current")


def _pick(items: tuple[str, ...], number: str) -> str:
    return f"case ({number}) % {len(items)} " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(items)) + " end"


def policy_sql(documents: str = "documents", versions: str = "(select 1 as version_ord union all select 2 as version_ord) v") -> str:
    """SQL of policies: doc_id, version_ord, markdown."""
    n = len(SENTENCES)
    second = "version_ord = 2 and doc_id % 12"
    s = lambda k, shift: _pick(SENTENCES, f"doc_id * {k} + {shift} + case when {second} = {shift % 12} then 1 else 0 end")
    lines = [
        f"'# ' || {_pick(TITLES, 'doc_id')}",
        "'**Document ID:** POL-AC-' || doc_id",
        "'<!-- Page 1 -->'",
        "'## 1. Scope'",
        s(1, 0),
        s(3, 5) + f" || ' ' || {s(7, 2)}",
        "''",
        "'#### 1.0.1 Duties'",
        "'The owner must:'",
        "''",
        f"'- ' || {_pick(BULLETS, 'doc_id')}",
        f"'- ' || {_pick(BULLETS, 'doc_id + 2')}",
        "''",
        "'```'",
        "'owners must not read code'",
        "'```'",
        "'## 2. Controls'",
        "'| Topic | Rule |'",
        "'|---|:---:|'",
        f"'| Rule | ' || {s(11, 8)} || ' |'",
        f"'| Both | Owners must approve access. <br> ' || {_pick(BULLETS, 'doc_id + 1')} || ' |'",
        "''",
        "'<!-- Page 2 -->'",
        f"{s(13, 9)}",
        f"case when {second} = 10 then '' else {s(17, 3)} end",
    ]
    fields = f"cast(doc_id as bigint) as doc_id, source, lang, cast((doc_id % 4) * 6 + 6 as varchar(9)) as months, cast(case when version_ord = 2 and doc_id % 3 = 0 then 8 else 24 end as varchar(9)) as hours, version_ord"
    return f"select doc_id, version_ord, concat_ws(chr(10), {', '.join(lines)}) as markdown from (select {fields} from {documents}, {versions}) p"


assert len(SENTENCES) == 20


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a policy for each row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang")
    return spark.sql(policy_sql("{docs}", "lateral explode(array(1, 2)) as v(version_ord)"), docs=docs)

#: (before, after) wordings; {n} stands for a number taken from the row
REWORDINGS = (
    ("Teams must review access within {n} hours.", "Teams must review access within 8 hours."),
    ("Teams must review access within 8 hours.", "Teams must review access within {n} hours."),
    ("All teams must encrypt backups.", "Selected teams must encrypt backups."),
    ("Owners must encrypt backups.", "Owners should encrypt backups."),
    ("Owners may share reports.", "Owners must share reports."),
    ("Owners must share reports.", "Owners must not share reports."),
    ("Operators must enable logging.", "Operators must disable logging."),
    ("Vendors must sign contracts.", "Vendors must sign contracts where feasible."),
    ("Vendors must sign contracts unless exempt.", "Vendors must sign contracts."),
    ("Logs must be retained for {n} months.", "Logs must be retained for 3 months."),
    ("Passwords must have at least {n} characters.", "Passwords must have at least 14 characters."),
    ("Owners must test recovery.", "Owners shall test recovery."),
    ("Owners must test recovery weekly.", "Owners must test recovery daily."),
    ("Owners must not export data.", "Owners may export data."),
    ("Owners must not export data.", "Owners should not export data."),
    ("Staff must report incidents immediately.", "Staff must report incidents."),
    ("Reviewers must check the register.", "Reviewers must inspect the whole register."),
    ("Staff must wear badges.", "All staff must wear badges."),
    ("Owners must review access.", "Owners must review access."),
)
#: (before, after) headings over the wordings
HEADINGS = (
    ("Access Control", "Access Control"), ("Access Control", "Identity and Access Control"), ("Access Control", "Production Access Control"), ("", ""), ("All Systems", "Systems"),
    ("Systems", "Each System"), ("Scope", "Selected Sites"),
)


def rewordings_sql(documents: str = "documents") -> str:
    """SQL of wording changes, one for each row of ``documents``: doc_id, before, after and their headings."""
    say = lambda k: _pick(tuple(r[k].replace("{n}", "' || n || '") for r in REWORDINGS), "doc_id")
    under = lambda k: _pick(tuple(h[k] for h in HEADINGS), "doc_id")
    return f"select doc_id, {say(0)} as before, {say(1)} as after, {under(0)} as before_heading, {under(1)} as after_heading from (select cast(doc_id as bigint) as doc_id, cast((doc_id % 5) * 4 + 6 as varchar(9)) as n from {documents}) p"


def rewordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(rewordings_sql("{docs}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))
