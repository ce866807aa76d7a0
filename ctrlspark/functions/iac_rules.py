"""Fixed values of the resource rules."""

from __future__ import annotations

# Domain, terms of the resource type, terms of its text (blanks left out), controls, roles.
RULES = (
    ("access_control", ("_iam_", "azuread_", "okta_", "identity", "sso", "access_policy", "service_account_key", "google_service_account", "role_definition"), ("multifactorauth", "multi-factor", "mfa", "assume_role", "principal"), ("AC-2", "AC-3", "IA-2"), ("preventive",)),
    ("logging", ("cloudtrail", "log_group", "diagnostic_setting", "audit", "securityhub", "guardduty", "sentinel", "logging_project_sink", "log_analytics_workspace", "config_configuration_recorder"), ("enable_logging", "audit_log", "log_destination", "event_selector"), ("AU-2", "AU-6", "SI-4"), ("detective",)),
    ("encryption", ("_kms_", "key_vault", "key_ring", "crypt", "certificate", "secretsmanager", "secret_manager_secret"), ("encrypted", "encryption", "kms_key", "customer_managed_key", "tls"), ("SC-12", "SC-13", "SC-28"), ("preventive",)),
    ("network_security", ("security_group", "network_acl", "firewall", "_waf", "cloud_armor", "compute_security_policy", "azurerm_network_security_rule"), ("cidr_blocks", "source_ranges", "0.0.0.0/0", "::/0", "ingress", "egress"), ("SC-7", "AC-4"), ("preventive",)),
    ("backup", ("backup", "recovery", "snapshot"), ("retention_days", "recovery_point", "backup_vault", "point_in_time_recovery"), ("CP-9", "CP-10"), ("recovery",)),
    ("vulnerability", ("inspector", "vulnerability", "patch", "defender"), ("scan", "patch_baseline", "vulnerability"), ("RA-5", "SI-2"), ("detective", "corrective")),
    ("change", ("config_rule", "policy_assignment", "organization_policy", "organizations_policy", "config_configuration_recorder"), ("compliance_rule", "configuration_policy", "policy_type"), ("CM-2", "CM-3", "CM-6"), ("governance", "preventive")),
    ("incident", ("incident", "event_rule", "eventbridge_rule", "response"), ("incident_response", "remediation", "response_plan"), ("IR-4", "IR-5"), ("detective", "corrective")),
    ("data_protection", ("s3_bucket", "storage_account", "storage_bucket", "azurerm_storage_container", "_rds_", "sql_database", "bigquery_dataset"), ("public_access", "versioning", "data_classification", "retention_policy"), ("AC-3", "SC-28", "MP-4"), ("preventive",)),
    ("access_control", ("accessanalyzer_analyzer",), (), ("AC-2", "AC-6", "CA-7"), ("detective",)),
)
#: shapes of a control id that an annotation may declare
CONTROL_SHAPES = (
    r"(?:AC|AT|AU|CA|CM|CP|IA|IR|MA|MP|PE|PL|PM|PS|PT|RA|SA|SC|SI|SR)-\d+(?:\(\d+\))?",
    r"(?:AAT|AST|BCD|CAP|CFG|CHG|CLD|CPL|CRY|DCH|EMB|END|GOV|HRS|IAC|IAO|IRO|MDM|MNT|MON|NET|OPS|PES|PRI|PRM|RSK|SAT|SEA|TDA|THR|TPM|VPM|WEB)-\d+(?:\.\d+)?",
    r"KSI-[A-Z0-9]+-[A-Z0-9]+",
    r"(?:CC|A1|C1|PI1|P1)\d*(?:\.\d+)+(?:-POF\d+)?",
    r"(?:A\.)?\d+(?:\.\d+)+",
    r"(?:GV|ID|PR|DE|RS|RC)\.[A-Z]{2}(?:-\d+)?",
    r"CIS\s*\d+(?:\.\d+)*",
    r"REQ\.?\s*\d+(?:\.\d+)*",
)
CONTROL_ID = "(?i)^(?:" + "|".join(CONTROL_SHAPES) + ")$"
#: settings that weaken a resource when they are false
DISABLED = r"(?i)\b(encrypted|enable_logging|logging_enabled|public_access_block|block_public_acls|block_public_policy|restrict_public_buckets|ignore_public_acls|mfa_delete|enable_key_rotation|point_in_time_recovery_enabled)\s*=\s*false\b"
#: parts of a type that make a change worth a look without a link
SENSITIVE_TYPES = ("iam", "mfa", "guardduty", "securityhub", "aws_s3_bucket_public", "aws_kms", "okta_", "azuread_")
#: tags that are kept, besides those that begin with grc_
TAGS = ("name", "policy_statement", "control_id", "control_ids", "doc_id", "link_id")
OPEN_NETWORKS = ("0.0.0.0/0", "::/0")
APPROVED = ("approved", "implemented")
