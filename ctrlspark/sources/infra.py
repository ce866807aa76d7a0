"""Infrastructure files, policy links and monitor runs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TYPE = "case p_partkey % 5 when 0 then 'aws_iam_role' when 1 then 'aws_s3_bucket' when 2 then 'aws_security_group' when 3 then 'aws_kms_key' else 'aws_cloudwatch_log_group' end"


#: what a resource declares about itself, by key, as (annotation key, SQL of its value, '' for none)
NOTES = (
    ("control_ids", "case p_partkey % 7 when 0 then 'AC-2|cc6.1' when 1 then 'XX-9, SC-28' else '' end"),
    ("domains", "case p_partkey % 11 when 2 then 'IAM' when 3 then 'Audit Logging|cookery' else '' end"),
    ("exception_id", "case when p_partkey % 18 = 0 then 'EX-1' else '' end"),
    ("link_id", "case when p_partkey % 2 = 0 then 'lnk-' || (p_partkey * 7 % {docs}) else '' end"),
    ("posture", "case when p_partkey % 13 = 5 then 'Approved' else '' end"),
    ("roles", "case when p_partkey % 17 = 4 then 'Detective' else '' end"),
)


#: program text in a resource: words of configuration in it are none
HEREDOC = "chr(10) || '  script = <<EOT' || chr(10) || 'encrypted = false' || chr(10) || '# grc: domains=backup' || chr(10) || '0.0.0.0/0 ' || chr(125) || chr(10) || 'EOT'"
_NAME = "'r' || case when p_partkey % 10 = 5 then p_partkey - 5 else p_partkey end"


def resources_sql(part: str = "part", revisions: str = "(select 1 as revision union all select 2 as revision) v", docs: str = "(select max(doc_id) + 21 from documents)") -> str:
    """SQL of resources in two revisions; some change, appear or go in the second.

    Links reach over all documents and a few ids beyond; a tenth of the addresses stand in two repositories.
    """
    notes = ", ".join(f"{value.replace('{docs}', docs)} as {key}" for key, value in NOTES)
    return f"""select p_partkey, 'infra-' || (p_partkey % 3) as repository, revision, 'modules/' || replace(lower(p_brand), '#', '') as module_path, 'modules/' || replace(lower(p_brand), '#', '') || '/main.tf' as relative_path,
        {_TYPE} as resource_type, {_NAME} as name, {_TYPE} || '.' || {_NAME} as address, {notes},
        'size = ' || p_size || chr(10) || '  encrypted = ' || case when revision = 2 and p_size % 3 = 0 then 'false' else 'true' end || case when p_partkey % 9 = 0 then chr(10) || '  cidr_blocks = [\"0.0.0.0/0\"]' else '' end || case when p_partkey % 8 = 3 then {HEREDOC} else '' end as body
        from {part}, {revisions} where not (revision = 2 and p_size % 7 = 0) and not (revision = 1 and p_size % 11 = 0)"""


#: SQL of a resource's block as it stands in its file
BLOCK = "'resource \"' || resource_type || '\" \"' || name || '\" {' || chr(10) || '  ' || body || chr(10) || '  note = \"resource [in] text\"' || chr(10) || '  tags = {' || chr(10) || '    grc_owner = \"v\"' || chr(10) || '  }' || chr(10) || '}'"


#: SQL of what a file begins with: in some modules the variable's default differs between revisions
HEAD = "'# resource \"none\" \"none\" {' || chr(10) || 'variable \"x\" {' || chr(10) || '  default = ' || case when relative_path like '%3/main.tf' then cast(revision as varchar(9)) else '0' end || chr(10) || '}' || chr(10)"


def note_sql() -> str:
    """SQL of the comment line above a resource, '' if it declares nothing."""
    pairs = " || ".join(f"case when {key} <> '' then '; {key}=' || {key} else '' end" for key, _ in NOTES)
    return f"case when ({pairs}) <> '' then '# grc: ' || substr({pairs}, 3) || chr(10) else '' end"


def files_sql(resources: str) -> str:
    """SQL of configuration files that hold the resources; comments and strings in them name resources too."""
    return f"select repository, revision, relative_path, {HEAD} || {{agg}} || chr(10) as content from (select *, {note_sql()} || {BLOCK} as block from ({resources}) q) b group by repository, revision, relative_path"


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return spark.sql(resources_sql("{part}", "lateral explode(array(1, 2)) as v(revision)", "(select max(doc_id) + 21 from {docs})"), part=part, docs=docs)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = "array_join(transform(array_sort(collect_list(struct(p_partkey, block))), x -> x.block), chr(10))"
    text = files_sql("select * from TABLE_R").replace("{agg}", agg)
    # braces of the text are doubled, as the formatter reads single ones as names
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("TABLE_R", "{r}"), r=resources(spark, sf_dir))


def links_sql(documents: str = "documents", array: str = "[{}]", none: str = "cast([] as varchar[])") -> str:
    """SQL of policy-to-code links, one for each policy: what the statement says, how it should be read, and where the code is."""
    some = lambda when, *items: f"case when {when} then {array.replace('{}', ', '.join(items))} else {none} end"
    return f"""select 'lnk-' || doc_id as link_id, cast(doc_id as bigint) as doc_id, case doc_id % 3 when 0 then 'revoke stale accounts' when 1 then 'encrypt' else 'no such words' end as anchor,
        {some("doc_id % 6 = 5", "'visitors'", "'must'")} as keywords, {some("doc_id % 5 < 3", "case doc_id % 5 when 0 then 'access_control' when 1 then 'encryption' else 'iam' end")} as expected_domains,
        case when doc_id % 4 = 1 then 'obligation' end as expected_kind, case when doc_id % 4 = 1 then 'must' end as expected_strength, case when doc_id % 8 = 1 then 'positive' end as expected_polarity,
        {some("doc_id % 4 = 3", "'aws_iam_role.r' || (doc_id * 10)")} as addresses, {some("doc_id % 100 = 2", "'aws_kms_key'")} as types, {some("doc_id % 100 = 2", "'modules/brand11'")} as paths, {some("doc_id % 9 = 4", "'infra-1'")} as repositories, {some("doc_id % 7 < 3", "case doc_id % 7 when 0 then 'AC-2' when 1 then 'IAC-15' else 'CC7.2' end")} as control_ids from {documents}"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return spark.sql(links_sql("{docs}", "array({})", "cast(array() as array<string>)"), docs=docs)


def assessments_sql(supplier: str = "supplier", array: str = "[{}]", none: str = "cast([] as bigint[])") -> str:
    """SQL of assessments: one for each supplier, for all policies or one."""
    some = lambda *items: array.replace("{}", ", ".join(items))
    return f"""select 'asm-' || s_suppkey as assessment_id, case s_suppkey % 3 when 0 then {some("'SOC 2'", "'NIST 800-53'")} when 1 then {some("'ISO 27001'")} else {some("'FedRAMP KSI'", "'NIST CSF 2.0'")} end as frameworks,
        case when s_suppkey % 50 = 0 then {none} else {some("cast(s_suppkey * 3 as bigint)")} end as doc_ids, case when s_suppkey % 4 = 3 then 'closed' else 'active' end as status, case when s_suppkey % 3 = 2 then case s_suppkey % 2 when 0 then 'b' else 'c' end else '' end as class_id from {supplier}"""


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(assessments_sql("{s}", "array({})", "cast(array() as array<bigint>)"), s=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def runs_sql(events: str = "events") -> str:
    """SQL of monitor runs: a user's events in time order."""
    return f"""select user_id as monitor_id, event_id as run_id, ts as run_ts, case event_type when 'error' then 'misaligned' when 'view' then 'aligned' else 'review_required' end as status, case when event_type = 'view' then '' else substr(props, 1, 8) end as finding,
        case event_type when 'error' then 'critical' when 'purchase' then 'high' when 'click' then 'medium' when 'signup' then 'low' else 'info' end as severity, 'rev-' || (event_id % 3) as input from {events}"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(runs_sql("{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))


def outcomes_sql(events: str = "events") -> str:
    """SQL of what came of sending a run's notice, had it one: known at once, and not always delivered."""
    return f"select user_id as monitor_id, event_id as run_id, ts, event_id % 4 <> 0 as delivered from {events}"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(outcomes_sql("{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
