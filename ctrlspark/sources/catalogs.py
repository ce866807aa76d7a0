"""Small catalogs for queries and tests; operators take catalogs as tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Topic seed (domain, framework, control, title).
SEED = [
    ("access_control", "NIST 800-53", "AC-2", "Account Management"),
    ("access_control", "NIST 800-53", "AC-3", "Access Enforcement"),
    ("access_control", "NIST 800-53", "IA-2", "Identification and Authentication"),
    ("access_control", "ISO 27001", "5.15", "Access control"),
    ("access_control", "ISO 27001", "8.5", "Secure authentication"),
    ("access_control", "SOC 2", "CC6.1", "Logical access security"),
    ("access_control", "NIST CSF 2.0", "PR.AA-01", "Identities and credentials"),
    ("access_control", "CIS Controls", "CIS 5.1", "Establish account inventory"),
    ("encryption", "NIST 800-53", "SC-13", "Cryptographic Protection"),
    ("encryption", "NIST 800-53", "SC-28", "Protection of Information at Rest"),
    ("encryption", "ISO 27001", "8.24", "Use of cryptography"),
    ("encryption", "SOC 2", "CC6.7", "Transmission and disposal"),
    ("encryption", "PCI DSS", "Req.3", "Protect stored account data"),
    ("logging", "NIST 800-53", "AU-2", "Event Logging"),
    ("logging", "NIST 800-53", "AU-6", "Audit Record Review"),
    ("logging", "ISO 27001", "8.15", "Logging"),
    ("logging", "SOC 2", "CC7.2", "System monitoring"),
    ("logging", "NIST CSF 2.0", "DE.CM-01", "Networks and systems monitored"),
    ("incident", "NIST 800-53", "IR-4", "Incident Handling"),
    ("incident", "ISO 27001", "5.26", "Response to information security incidents"),
    ("incident", "SOC 2", "CC7.3", "Incident evaluation"),
    ("incident", "NIST CSF 2.0", "RS.MA-01", "Incident management"),
    ("vendor", "NIST 800-53", "SR-3", "Supply Chain Controls"),
    ("vendor", "ISO 27001", "5.19", "Information security in supplier relationships"),
    ("vendor", "SOC 2", "CC9.2", "Vendor risk management"),
    ("privacy", "NIST 800-53", "PT-2", "Authority to Process Personally Identifiable Information"),
    ("privacy", "ISO 27001", "5.34", "Privacy and protection of PII"),
    ("privacy", "SOC 2", "P1.0", "Privacy criteria"),
    ("backup", "NIST 800-53", "CP-9", "System Backup"),
    ("backup", "ISO 27001", "8.13", "Information backup"),
    ("backup", "NIST CSF 2.0", "PR.DS-11", "Backups"),
    ("change", "NIST 800-53", "CM-3", "Configuration Change Control"),
    ("change", "ISO 27001", "8.32", "Change management"),
    ("change", "SOC 2", "CC8.1", "Change management"),
]

#: a made-up control catalog in the shape of the real one: (control, domain, title)
SCF = [
    ("IAC-01", "access_control", "Identity programme"),
    ("IAC-07", "access_control", "Account lifecycle"),
    ("IAC-15", "access_control", "Account management"),
    ("CRY-01", "encryption", "Use of cryptography"),
    ("CRY-05", "encryption", "Encryption at rest"),
    ("BCD-11", "backup", "Data backups"),
    ("MON-01", "logging", "Continuous monitoring"),
    ("IRO-02", "incident", "Incident handling"),
    ("TPM-03", "vendor", "Supply chain protection"),
    ("CHG-02", "change", "Configuration change control"),
]
#: (control, framework, their id); also read from right to left
SCF_CROSSWALK = [
    ("IAC-01", "NIST 800-53", "IA-01"), ("IAC-01", "ISO 27001", "5.16"), ("IAC-07", "NIST 800-53", "AC-02"), ("IAC-07", "SOC 2", "CC6.2"),
    ("IAC-15", "NIST 800-53", "AC-02"), ("IAC-15", "NIST 800-53", "AC-03"), ("IAC-15", "ISO 27001", "5.18"), ("CRY-01", "NIST 800-53", "SC-13"),
    ("CRY-05", "NIST 800-53", "SC-28"), ("CRY-05", "PCI DSS", "3.5"), ("BCD-11", "NIST 800-53", "CP-09"), ("BCD-11", "NIST CSF 2.0", "PR.DS-11"),
    ("MON-01", "NIST 800-53", "AU-02"), ("MON-01", "SOC 2", "CC7.2"), ("IRO-02", "NIST 800-53", "IR-04"), ("IRO-02", "ISO 27001", "5.26"),
    ("TPM-03", "ISO 27001", "A.5.19"), ("TPM-03", "CIS Controls", "5.1"), ("CHG-02", "NIST 800-53", "CM-03"),
]
#: a made-up indicator catalog: (id, control, status by class a to d)
KSI = [
    ("KSI-IAM-01", "ac-2", "optional", "applicable", "applicable", "required"),
    ("KSI-IAM-02", "ac-2.1", "not_applicable", "applicable", "required", "required"),
    ("KSI-IAM-03", "ia-2", "applicable", "applicable", "applicable", "applicable"),
    ("KSI-MLA-01", "au-2", "optional", "optional", "applicable", "required"),
    ("KSI-MLA-02", "cc7.2", "applicable", "applicable", "applicable", "applicable"),
    ("KSI-INR-01", "ir-4", "not_applicable", "optional", "applicable", "required"),
    ("KSI-SVC-01", "sc-28", "applicable", "applicable", "applicable", "applicable"),
    ("KSI-RPL-01", "cp-9", "optional", "applicable", "applicable", "applicable"),
    ("KSI-CED-01", "at-2", "applicable", "applicable", "applicable", "applicable"),
    ("KSI-CNA-01", "sc-7", "not_applicable", "not_applicable", "applicable", "required"),
]
#: fixed values: topic words by indicator group
KSI_WORDS = {
    "IAM": ("account", "mfa", "privileged", "authentication", "identity", "least privilege"),
    "MLA": ("log", "audit", "siem", "monitor"),
    "CMT": ("change management", "configuration", "deploy"),
    "INR": ("incident", "breach", "response"),
    "SVC": ("encrypt", "secret", "configuration"),
    "PIY": ("inventory", "policy", "sdlc"),
    "RPL": ("backup", "recovery", "continuity"),
    "SCR": ("vendor", "supply chain", "third party"),
    "CED": ("training", "awareness"),
    "CNA": ("network", "segmentation", "cloud native"),
}

#: made-up snapshots: (prefix of cited ids, target, control, title), (section, name) and documentation duties (id, name, general statement, force by class)
PREFIX_MAP = [
    ("AC", "OSA 800-53", "AC-01", "Access policy"), ("AC", "OSA 800-53", "AC-02", "Accounts"), ("IA", "OSA 800-53", "IA-02", "Identification"), ("CC", "OSA SOC", "CC6", "Logical access"),
]
SECTIONS = [("CRE-100", "Access control and account management"), ("CRE-200", "Encryption at rest SC-28"), ("CRE-300", "Incident response"), ("CRE-400", "Backup CP-9"), ("CRE-500", "Vendor management"), ("CRE-600", "Logging and audit AU-2")]
DUTIES = [
    ("DOC-01", "Package overview", "yes", "", "", "MUST", "MUST"), ("DOC-02", "Key metrics", "", "MAY", "SHOULD", "MUST", "MUST"), ("DOC-03", "Maintenance", "yes", "", "MUST", "", "MUST"),
    ("DOC-04", "Trust record", "", "", "MUST", "MUST", ""), ("DOC-05", "Change log", "yes", "MUST", "MUST", "MUST", "MUST"), ("DOC-06", "Scope map", "", "", "MUST", "MUST", "MUST"),
]

# How often the certification package is to be maintained where that is a duty (class, number, unit).
CADENCES = [("b", "1", "months"), ("c", "2", "weeks"), ("d", "1", "weeks")]

_TABLES = {
    "cadences": (CADENCES, "class_id string, number string, unit string, ord int"),
    "prefix_map": (PREFIX_MAP, "prefix string, target string, control_id string, title string, ord int"),
    "sections": (SECTIONS, "section_id string, name string, ord int"),
    "duties": (DUTIES, "req_id string, name string, statement string, a string, b string, c string, d string, ord int"),
    "seed": (SEED, "domain string, framework string, control_id string, title string, ord int"),
    "scf": (SCF, "control_id string, domain string, title string, ord int"),
    "scf_crosswalk": (SCF_CROSSWALK, "scf_id string, framework string, control_id string, ord int"),
    "ksi": (KSI, "ksi_id string, control string, a string, b string, c string, d string, ord int"),
    "ksi_words": ([(g, w) for g, ws in KSI_WORDS.items() for w in ws], "grp string, word string, ord int"),
}


def catalog(spark: SparkSession, name: str) -> DataFrame:
    """A table of values: its size is known to the planner, so it is the side that joins broadcast."""
    return spark.sql(catalog_sql(name)).to(StructType.fromDDL(_TABLES[name][1]))


def catalog_sql(name: str) -> str:
    """The rows as a VALUES list, for both engines."""
    rows, schema = _TABLES[name]
    columns = ", ".join(c.split()[0] for c in schema.split(", "))
    values = ", ".join("(" + ", ".join(f"'{v}'" for v in r) + f", {i})" for i, r in enumerate(rows))
    return f"select * from (values {values}) t({columns})"
