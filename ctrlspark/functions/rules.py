"""Fixed values and expressions of the statement rules."""

from __future__ import annotations

from .dialect import Dialect

# Words and patterns that decide results.
MODAL = (
    r"(?i)\b(must never|shall never|should never|must not|shall not|should not|may not|cannot|must|shall|should|may|has to|have to|needs to|need to"
    r"|is required(?: to)?|are required(?: to)?|is prohibited|are prohibited|is not permitted|are not permitted"
    r"|will (?:ensure|maintain|review|monitor|perform|document|retain|protect|implement|enforce)|is responsible for|are responsible for)\b"
)
WAIVER = r"(?i)\b(?:do|does)\s+not\s+have\s+to\b|\bneed\s+not\b|\b(?:is|are)\s+(?:not\s+|no\s+longer\s+)required(?:\s+to)?\b"
EPISTEMIC = (
    r"(?i)\bmay\s+(?:result|cause|occur|indicate|include|also\s+include|be\s+caused|be\s+due|vary|change|fail|expose|contain|become|lead\s+to)\b",
    r"(?i)\bcannot\s+(?:support|determine|verify|connect|operate|function|be\s+(?:available|supported|verified|determined|recovered))\b",
    r"(?i)\bmay\s+not\s+(?:result|cause|occur|indicate|include|reflect|exist|be\s+(?:available|possible|accurate|complete|applicable|supported|present|reliable))\b",
)
#: whole sentences about what a system can do, and the verb that carries no duty there
SYSTEM_ABILITY = {
    "may": r"(?i)^\s*(?:the\s+)?(?:application|device|platform|service|software|system)\b[^.!?]*\bmay\s+(?:generate|produce)\b",
    "may not": r"(?i)^\s*(?:the\s+)?(?:application|device|platform|service|software|system|vendor)\b[^.!?]*\bmay\s+not\s+support\b",
    "cannot": r"(?i)^\s*(?:the\s+)?(?:application|device|platform|service|software|system)\b[^.!?]*\bcannot\s+encrypt\b",
}
CONTROL_ID = (
    r"(?i)(?:^|[^A-Za-z-])((?:AC|AT|AU|CA|CM|CP|IA|IR|MA|MP|PE|PL|PM|PS|PT|RA|SA|SC|SI|SR)-\d+(?:\(\d+\))?"
    r"|(?:AAT|AST|BCD|CAP|CFG|CHG|CLD|CPL|CRY|DCH|EMB|END|GOV|HRS|IAC|IAO|IRO|MDM|MNT|MON|NET|OPS|PES|PRI|PRM|RSK|SAT|SEA|TDA|THR|TPM|VPM|WEB)-\d+(?:\.\d+)?"
    r"|A\.?\d+(?:\.\d+)+|CC\d+\.\d+|PR\.(?:AA|AT|CM|DS|IP|PT)-\d+|GV\.(?:OC|RM|RR|PO|OV)-\d+|ID\.(?:AM|RA|IM)-\d+|DE\.(?:CM|AE)-\d+|RS\.(?:MA|AN|CO|MI)-\d+|RC\.(?:RP|CO)-\d+"
    r"|CIS\s*\d+(?:\.\d+)?|Req\.?\s*\d+(?:\.\d+)*)\b"
)
DOMAIN_WORDS: dict[str, tuple[str, ...]] = {
    "access_control": ("access", "account", "authentication", "authorization", "identity", "mfa", "multi-factor", "password", "privileged", "role"),
    "asset": ("asset", "inventory", "device", "system component"),
    "awareness": ("awareness", "training", "phishing exercise"),
    "backup": ("backup", "recovery", "continuity", "disaster"),
    "change": ("change management", "configuration", "baseline"),
    "data_protection": ("data protection", "data classification", "data retention", "data disposal"),
    "encryption": ("encrypt", "encryption", "cryptographic", "cryptography", "tls", "key management", "certificate", "secret"),
    "governance": ("governance", "oversight", "policy approval", "management review"),
    "incident": ("incident", "breach", "response", "forensic"),
    "logging": ("log", "logging", "audit trail", "monitoring", "siem", "telemetry"),
    "network_security": ("firewall", "network", "segmentation", "ingress", "egress", "boundary"),
    "physical": ("physical access", "facility", "visitor", "badge"),
    "privacy": ("personal data", "pii", "privacy", "gdpr", "data subject"),
    "risk": ("risk assessment", "risk treatment", "risk register"),
    "secure_development": ("secure development", "code review", "software development", "sdlc"),
    "vendor": ("vendor", "third party", "supplier", "processor"),
    "vulnerability": ("vulnerability", "patch", "scan", "weakness", "remediation"),
}
DOMAIN_ALIASES = {
    "access": "access_control", "access_management": "access_control", "identity": "access_control", "identity_and_access_management": "access_control",
    "audit": "logging", "audit_logging": "logging", "business_continuity": "backup", "configuration": "change", "configuration_management": "change",
    "cryptography": "encryption", "data_security": "data_protection", "iam": "access_control", "incident_response": "incident", "network": "network_security",
    "security_awareness": "awareness", "supplier": "vendor", "third_party": "vendor", "vulnerability_management": "vulnerability",
}
PROHIBITIONS = ("must never", "shall never", "must not", "shall not", "may not", "cannot", "is prohibited", "are prohibited", "is not permitted", "are not permitted")
MANDATORY = ("must", "has to", "have to", "needs to", "need to", "is required", "is required to", "are required", "are required to", "will ensure", "will maintain", "will review", "will monitor", "will perform", "will document", "will retain", "will protect", "will implement", "will enforce")
RESPONSIBLE = ("is responsible for", "are responsible for")
ADVICE = ("should", "should not", "should never")
NEGATIVE_ACTIONS = ("block", "deny", "disable", "prevent", "prohibit", "reject", "revoke", "blocked", "denied", "disabled", "prevented", "prohibited", "rejected", "revoked")
CONTROL_WORDS = ("control", "procedure", "standard", "requirement", "safeguard")
METADATA_STARTS = ("document id", "**document id", "version:", "approved by:")


def without_epistemic(d: Dialect, x: str) -> str:
    """The text with words blanked that look like modals but state likelihood."""
    plain = x
    for pattern in EPISTEMIC:
        x = d.sub(x, pattern, "#")
    # all these patterns hold one of two words
    return f"case when contains(lower({plain}), 'may') or contains(lower({plain}), 'cannot') then {x} else {plain} end" if d.spark else x


def verbs(d: Dialect, x: str) -> str:
    """Lower-case modal verbs that carry a duty, in order."""
    found = d.transform(d.all(without_epistemic(d, x), MODAL, 1), "v", "lower(v)")
    idle = " and ".join(f"not (v = '{verb}' and {d.rx(x, pattern)})" for verb, pattern in SYSTEM_ABILITY.items())
    return d.filter(found, "v", idle)


def has_modal(d: Dialect, x: str) -> str:
    return f"({d.rx(x, WAIVER)} or {d.size(verbs(d, x))} > 0)"


def has_verb(d: Dialect, x: str) -> str:
    return f"{d.size(verbs(d, x))} > 0"


def shared_prefix(d: Dialect, x: str, found: str | None = None) -> str:
    """Subject and modal (and "be") that a following action can inherit; '' without a modal.

    Here and below, columns that hold what was found before (``found``: the verbs of ``x``) save looking again.
    """
    clean = without_epistemic(d, x)
    body = MODAL[len(r"(?i)") :]
    return f"case when {d.size(found or verbs(d, x))} > 0 then trim({d.extract(clean, r'(?i)^(.*?' + body + r'(?:\s+be\b)?)', 1)}) else '' end"


def control_ids(d: Dialect, x: str) -> str:
    """Cited control ids, upper case without blanks, sorted and distinct.

    The character before an id isn't part of it; a second pass over the text with
    the first pass's separators doubled is not needed, as ids are separated by more
    than one character or by one that starts no id.
    """
    found = d.transform(d.all(d.sub(x, r"([,;\s])", "{1}{1}"), CONTROL_ID, 1), "c", f"upper({d.sub('c', ' ', '')})")
    ids = d.sort(d.distinct(found))
    # every id has a digit
    return f"case when {d.rx(x, '[0-9]')} then {ids} else cast(array() as array<string>) end" if d.spark else ids


def domain_pattern(domain: str) -> str:
    words = [w for w in DOMAIN_WORDS[domain] if " " not in w and "-" not in w]
    phrases = [w for w in DOMAIN_WORDS[domain] if w not in words]
    single = [rf"\b(?:{'|'.join(words)})(?:s|ed|ing)?\b"] if words else []
    return "|".join([*single, *phrases])


def domains(d: Dialect, x: str) -> str:
    """Domains whose words occur in ``x`` (lower case), sorted."""
    # a pattern is tried where one of its words stands
    near = lambda words: f"({' or '.join(f'contains({x}, {w!r})' for w in words)}) and " if d.spark else ""
    items = [f"case when {near(words)}{d.rx(x, domain_pattern(name))} then '{name}' end" for name, words in DOMAIN_WORDS.items()]
    return d.filter(d.array(items), "k", "k is not null")


def is_candidate(d: Dialect, x: str, modal: str | None = None, low: str | None = None) -> str:
    low = low or f"lower(trim({x}))"
    meta = " or ".join(f"{low} like '{s}%'" for s in METADATA_STARTS)
    words = " or ".join(f"{low} like '%{w}%'" for w in CONTROL_WORDS)
    described = f"(({words}) and {d.size(domains(d, low))} > 0)"
    cited = d.rx(x, CONTROL_ID)
    return f"not ({meta} or {low} like '%?') and ({modal or has_modal(d, x)} or {cited} or (not {d.rx(x, MODAL)} and {described}))"


def _any(d: Dialect, xs: str, values: tuple[str, ...]) -> str:
    return d.overlap(xs, d.strings(values))


def classify(d: Dialect, x: str, modal_verbs: str, ids: str, waived: str | None = None) -> dict[str, str]:
    """statement_kind, strength and raw confidence as ordered cases."""
    ladder = (
        (waived or d.rx(x, WAIVER), "permission", "may", "0.96"),
        (_any(d, modal_verbs, PROHIBITIONS), "prohibition", "prohibited", "0.98"),
        (d.has(modal_verbs, "'shall'"), "obligation", "shall", "0.97"),
        (_any(d, modal_verbs, MANDATORY), "obligation", "must", "0.96"),
        (_any(d, modal_verbs, RESPONSIBLE), "responsibility", "must", "0.9"),
        (_any(d, modal_verbs, ADVICE), "recommendation", "should", "0.9"),
        (d.has(modal_verbs, "'may'"), "permission", "may", "0.78"),
        (f"{d.size(ids)} > 0", "citation", "descriptive", "0.84"),
    )
    last = ("control_description", "descriptive", "0.66")
    out = {}
    for k, name in enumerate(("statement_kind", "strength", "confidence")):
        value = (lambda v: v) if name == "confidence" else (lambda v: f"'{v}'")
        out[name] = "cast(case " + " ".join(f"when {row[0]} then {value(row[1 + k])}" for row in ladder) + f" else {value(last[k])} end as {'double' if name == 'confidence' else 'string' if d.spark else 'varchar'})"
    return out


def polarity(d: Dialect, x: str, modal_verbs: str) -> str:
    """negative if the first modal denies, or allows or demands an action that stops something."""
    first = d.item(modal_verbs, 1)
    clean = without_epistemic(d, x)
    body = MODAL[len(r"(?i)") :]
    action = f"lower({d.extract(clean, r'(?i)^.*?' + body + r'\s+(?:not\s+|never\s+)?(?:be\s+)?([a-z]+)', 2)})"
    denies = d.rx(f"coalesce({first}, '')", r" not|never|^cannot$|prohibited|not permitted")
    return f"case when {d.size(modal_verbs)} = 0 then 'positive' when {denies} then 'negative' when {action} in ({', '.join(repr(a) for a in NEGATIVE_ACTIONS)}) then 'negative' else 'positive' end"


def framework(d: Dialect, c: str) -> str:
    """Framework that a cited id belongs to."""
    u = f"upper({c})"
    return (
        f"case when {d.rx(u, r'^(?:AC|AT|AU|CA|CM|CP|IA|IR|MA|MP|PE|PL|PM|PS|PT|RA|SA|SC|SI|SR)-\d+')} then 'NIST 800-53' "
        f"when {d.rx(u, r'^(?:AAT|AST|BCD|CAP|CFG|CHG|CLD|CPL|CRY|DCH|EMB|END|GOV|HRS|IAC|IAO|IRO|MDM|MNT|MON|NET|OPS|PES|PRI|PRM|RSK|SAT|SEA|TDA|THR|TPM|VPM|WEB)-\d+')} then 'SCF' "
        f"when {u} like 'CC%' or {u} like 'P1%' or {u} like 'A1%' then 'SOC 2' "
        f"when {d.rx(u, r'^\d+\.\d+')} or {u} like 'A.%' then 'ISO 27001' "
        f"when {u} like 'PR.%' or {u} like 'GV.%' or {u} like 'ID.%' or {u} like 'DE.%' then 'NIST CSF 2.0' "
        f"when {u} like 'CIS%' then 'CIS Controls' when {u} like 'REQ%' then 'PCI DSS' else 'Unknown' end"
    )


def normal_domain(d: Dialect, x: str) -> str:
    """A label in snake case with aliases resolved."""
    snake = d.sub(d.sub(f"lower(trim({x}))", r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return f"case {snake} " + " ".join(f"when '{a}' then '{b}'" for a, b in DOMAIN_ALIASES.items()) + f" else {snake} end"
