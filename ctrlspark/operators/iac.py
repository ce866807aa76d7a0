"""Infrastructure-as-code resources: extraction from files, identity and differences between revisions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iac_rules as rules
from ..functions.dialect import SPARK
from ..functions.rules import DOMAIN_WORDS, normal_domain
from ..sources.tables import staged

#: labels that a declared domain may have after normalisation
DOMAINS = tuple(DOMAIN_WORDS)

EXCLUDED = r"(^|/)(\.git|\.terraform|\.terragrunt-cache|\.venv|node_modules)(/|$)"
IDENTITY = ["repository", "module_path", "address"]
_RESOURCE = re.compile(r'^[ \t]*resource[ \t]+"([^"]+)"[ \t]+"([^"]+)"[ \t]*\{', re.M)
_STRING, _COMMENT = r'"(?:[^"\\]|\\.)*+"', r"#[^\n]*|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
#: a heredoc runs to the line that holds its word alone, or to the end; its text is no configuration
_HEREDOC = r"<<-?\s*([A-Za-z_]\w*)[^\n]*\n(?:[\s\S]*?\n)??[ \t]*\{}[ \t\r]*(?=\n|\Z)|<<-?\s*[A-Za-z_]\w*[\s\S]*"
_SKIP = re.compile(f"({_STRING})|{_COMMENT}|{_HEREDOC.replace('{}', '2')}")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text) if "\n" in text else " " * len(text)


def masks(text: str) -> tuple[str, str]:
    """The text with comments and heredocs blanked, without and with its strings, same length."""
    bare, code, at = [], [], 0
    for m in _SKIP.finditer(text):
        between, blank = text[at : m.start()], _blank(m[0])
        bare += (between, blank)
        code += (between, m[0] if m[1] else blank)
        at = m.end()
    return "".join((*bare, text[at:])), "".join((*code, text[at:]))


def masked(text: str, strings: bool = True) -> str:
    """The text with comments and heredocs (and strings) blanked, same length."""
    return masks(text)[0 if strings else 1]


def _closing(bare: str, wanted: set[int]) -> dict[int, int]:
    """Where the brace that closes each wanted opening one stands."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            open_.append(m.start())
        elif open_ and (begin := open_.pop()) in wanted:
            out[begin] = m.start()
    return out


def blocks_of(text: str) -> list[dict]:
    """Resource blocks: type, name, place, first line, whole text, tags, and the annotations of comment lines right above."""
    return list(each_block(text))


def each_block(text: str) -> Iterator[dict]:
    """``blocks_of``, one by one: what is held grows with the file's text, not with what its blocks say."""
    bare, code = masks(text)
    found = lambda: (m for m in _RESOURCE.finditer(text) if bare[m.start() : m.end()].strip().startswith("resource"))  # noqa: E731  # others are inside a comment or a string
    closing = _closing(bare, {m.end() - 1 for m in found()})
    row, counted = 0, 0
    for m in found():
        end = closing.get(m.end() - 1, len(text) - 1) + 1
        row, counted = row + text.count("\n", counted, m.start()), m.start()
        begin = above = text.rfind("\n", 0, m.start()) + 1
        while above and text[(before := text.rfind("\n", 0, above - 1) + 1) : above].strip().startswith(("#", "//")):
            above = before
        notes, tags = annotations_of(text[above:begin]), tags_of(code[m.start() : end])
        yield {"link_id": notes.get("link_id") or tags.get("link_id") or "", "resource_type": m[1], "name": m[2], "start_line": row + 1, "block": text[m.start() : end].strip(), "code": code[m.start() : end], "annotations": notes, "tags": tags, "span_start": m.start(), "span_end": end}


_NOTE = re.compile(r"(?:#|//)\s*grc:\s*(.+)$", re.I | re.M)
_NOTE_PAIR = re.compile(r"(?:^|[;,])\s*([A-Za-z0-9_.-]+)\s*=")
_TAG_PAIR = re.compile(r'"?([A-Za-z0-9_.-]+)"?\s*=\s*"([^"]*)"')


def annotations_of(text: str) -> dict[str, str]:
    """Pairs of comment lines like ``# grc: key=value; key=value``; keys in lower case, the last of equal ones stays."""
    out = {}
    for note in _NOTE.finditer(text):
        body = note[1].strip()
        pairs = list(_NOTE_PAIR.finditer(body))
        for pair, after in zip(pairs, [p.start() for p in pairs[1:]] + [len(body)]):
            value = body[pair.end() : after].strip().strip(";,").strip().strip('"')
            if value:
                out[pair[1].strip().lower()] = value
    return out


def tags_of(block: str) -> dict[str, str]:
    """Tags that the rules know, from the tags block if there is one, else from the whole block."""
    inner = re.search(r"tags\s*=\s*\{([^{}]*)\}", block, re.S)
    found = {}
    for key, value in _TAG_PAIR.findall(inner[1] if inner else block):
        low = key.lower()
        if low in rules.TAGS or low.startswith("grc_"):
            found["Name" if key == "Name" else low] = value
    return found


#: blocks, and characters of them, that are handed over at a time
BATCH, BATCH_CHARS = 2_000, 2_000_000
_STRINGS = pa.map_(pa.string(), pa.string())
_RESOURCES = pa.schema([
    ("repository", pa.string()), ("revision", pa.int32()), ("relative_path", pa.string()), ("module_path", pa.string()), ("address", pa.string()), ("resource_type", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("link_id", pa.string()),
    ("annotations", _STRINGS), ("tags", _STRINGS), ("content_hash", pa.string()), ("snippet", pa.string()), ("block", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("code", pa.string())])


def _resource_rows(files: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Resources of (repository, revision, path, content) in batches of a bounded size, however many a file holds."""
    rows, chars = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESOURCES)], schema=_RESOURCES)
    for repository, revision, path, content in files:
        for b in each_block(content or ""):
            rows.append((repository, revision, path, path.rpartition("/")[0], f"{b['resource_type']}.{b['name']}", b["resource_type"], b["name"], b["start_line"], b["link_id"], list(b["annotations"].items()), list(b["tags"].items()), hashlib.sha256(b["block"].encode()).hexdigest(), b["block"][:500], b["block"], b["span_start"], b["span_end"], b["code"]))
            chars += len(b["block"])
            if len(rows) >= BATCH or chars >= BATCH_CHARS:
                yield batch()
                rows, chars = [], 0
    if rows:
        yield batch()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of arrow batches, one by one."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def iac_extract(files: DataFrame) -> DataFrame:
    """One row per resource block of ``files(repository, revision, relative_path, content)``; cache folders are left out."""
    schema = "repository string, revision int, relative_path string, module_path string, address string, resource_type string, name string, start_line int, link_id string, annotations map<string,string>, tags map<string,string>, content_hash string, snippet string, block string, span_start int, span_end int, code string"
    wanted = files.filter(F.col("relative_path").endswith(".tf") & ~F.col("relative_path").rlike(EXCLUDED))
    return wanted.select("repository", F.col("revision").cast("int"), "relative_path", "content").mapInArrow(lambda batches: _resource_rows(_each(batches)), schema)


def _canonical(column: str) -> Column:
    """A map as text, entries in order, so that maps can be compared."""
    return F.to_json(F.array_sort(F.map_entries(column)))


def iac_diff(resources: DataFrame, older: int, newer: int) -> DataFrame:
    """Resources added, removed or changed (content, annotations or tags) between two revisions, by identity."""
    for name in ("annotations", "tags", "resource_type"):  # tables without them have nothing to compare there
        if name not in resources.columns:
            resources = resources.withColumn(name, F.lit("") if name == "resource_type" else F.create_map().cast("map<string,string>"))
    side = lambda r, n: resources.filter(F.col("revision") == r).select(*IDENTITY, F.struct("content_hash", "link_id", _canonical("annotations").alias("notes"), _canonical("tags").alias("tags"), "resource_type").alias(n))
    both = side(older, "a").join(side(newer, "b"), IDENTITY, "full_outer")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(*IDENTITY, kind.alias("change"), F.coalesce("b.link_id", "a.link_id").alias("link_id"), F.coalesce("b.resource_type", "a.resource_type").alias("resource_type")).filter("change is not null")


def control_id_valid(control_id: Column) -> Column:
    """Whether the text has one of the shapes of a control id."""
    return F.trim(control_id).rlike(rules.CONTROL_ID)


def _first(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def _listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,|]"), lambda x: F.trim(x)), lambda x: x != "")


def iac_classify(resources: DataFrame) -> DataFrame:
    """Domains, controls, roles, confidence, posture and status of resources by type, text, annotations and tags.

    Reads resource_type, block, annotations and tags; null ones are empty.  Adds
    domains, control_ids and roles (sorted), unknown_domains (declared ones that no
    rule knows, as a row can't be refused), security_sensitive, confidence, posture
    and status.
    """
    note = lambda key: F.try_element_at("annotations", F.lit(key))
    tag = lambda key: F.try_element_at("tags", F.lit(key))
    # comments and heredocs go, strings stay; extraction has done so already
    code = F.coalesce("code", F.lit("")) if "code" in resources.columns else F.regexp_replace(F.coalesce("block", F.lit("")), f"({_STRING})|{_COMMENT}|{_HEREDOC.replace('{}', '2')}", "$1")
    r = resources.withColumns({"__code": code, "__type": F.lower(F.coalesce("resource_type", F.lit(""))), "__controls": _listed(_first(note("control_ids"), note("control_id"), tag("control_ids"), tag("control_id"))), "__domains": _listed(_first(note("domains"), note("domain"), tag("grc_domains"), tag("grc_domain"))), "__roles": _listed(_first(note("roles"), note("role"), tag("grc_roles"), tag("grc_role")))})
    r = r.withColumn("__text", F.replace(F.lower("__code"), F.lit(" "), F.lit("")))
    has = lambda column, terms: F.expr(" or ".join(f"contains({column}, '{t.replace(' ', '')}')" for t in terms) or "false")
    r = r.withColumns({"__by_type": F.array(*(has("__type", x[1]) for x in rules.RULES)), "__by_text": F.array(*(has("__text", x[2]) for x in rules.RULES))})
    hit = lambda k: F.col("__by_type")[k] | F.col("__by_text")[k]
    of = lambda which: F.flatten(F.array(*(F.when(hit(k), F.array(*map(F.lit, (x[which],) if isinstance(x[which], str) else x[which]))).otherwise(F.array().cast("array<string>")) for k, x in enumerate(rules.RULES))))
    valid = F.filter("__controls", control_id_valid)
    r = r.withColumns({"__valid": F.transform(valid, F.upper), "__invalid": F.filter("__controls", lambda x: ~control_id_valid(x)), "__open": has("__code", rules.OPEN_NETWORKS), "__off": F.col("__code").rlike(rules.DISABLED)})
    normal = F.expr(f"transform(__domains, d -> {normal_domain(SPARK, 'd')})")
    r = r.withColumn("__normal", normal)
    lit = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    domains = F.array_sort(F.array_distinct(F.concat(of(0), F.array_intersect("__normal", lit(*DOMAINS)), F.when(F.col("__open"), lit("network_security")).otherwise(lit()))))
    controls = F.array_sort(F.array_distinct(F.concat(of(3), F.col("__valid"), F.when(F.col("__open"), lit("SC-7", "AC-4")).otherwise(lit()))))
    roles = F.concat(of(4), F.transform("__roles", F.lower), F.when(F.col("__open"), lit("preventive", "exposure")).otherwise(lit()))
    linked = _first(note("link_id"), tag("link_id")) != ""
    both = F.exists(F.arrays_zip("__by_type", "__by_text"), lambda x: x["__by_type"] & x["__by_text"])
    any_ = lambda c: F.exists(c, lambda x: x)
    least = lambda when, value: F.when(when, F.lit(value)).otherwise(F.lit(0.0))
    some = lambda c: F.size(c) > 0
    confidence = F.least(F.lit(0.99), F.greatest(
        least(any_("__by_type"), 0.82), least(any_("__by_text"), 0.74), least(both, 0.9), least(some("__valid"), 0.99), least(some("__invalid"), 0.5),
        least(some("__domains"), 0.98), least(some("__roles"), 0.98), least(linked, 0.97), least(F.col("__open") | F.col("__off"), 0.92)))
    r = r.withColumns({"domains": domains, "control_ids": controls, "roles": F.when(F.col("__off"), lit("configuration_risk")).otherwise(F.array_sort(F.array_distinct(roles))), "unknown_domains": F.array_except("__normal", lit(*DOMAINS)), "confidence": F.round(confidence, 2)})
    r = r.withColumns({"security_sensitive": some("domains") | some("__controls") | linked, "__reviewed": some("__valid") | some("__domains") | some("__roles")})
    approved = F.lower(F.coalesce(note("posture"), F.lit(""))).isin(*rules.APPROVED) | F.lower(F.coalesce(tag("grc_posture"), F.lit(""))).isin(*rules.APPROVED) | (_first(note("exception_id"), tag("grc_exception_id")) != "")
    posture = F.when(F.col("__off"), "violated").when(some("__invalid") | (F.col("__open") & ~approved), "review_required").when(F.col("security_sensitive") & (F.col("__reviewed") | (F.col("confidence") >= 0.85)), "implemented").otherwise("unknown")
    r = r.withColumn("posture", posture)
    status = F.when(F.col("posture") == "violated", "misconfigured").when(F.col("posture") == "review_required", "review_required").when(F.col("__reviewed"), "reviewed_annotation").when(F.col("security_sensitive") & (F.col("confidence") >= 0.85), "classified").when(F.col("security_sensitive"), "review_required").otherwise("not_security_relevant")
    return r.withColumn("status", status).drop(*(c for c in r.columns if c.startswith("__")))


def identity_duplicates(resources: DataFrame) -> DataFrame:
    """Identities that one revision holds more than once."""
    return resources.groupBy(*IDENTITY, "revision").agg(F.count("*").alias("n")).filter("n > 1")


def file_evidence(files: DataFrame, resources: DataFrame) -> DataFrame:
    """Hash of each file and the number of resources parsed from it."""
    key = ["repository", "revision", "relative_path"]
    counted = resources.groupBy(*key).agg(F.count("*").alias("n"))
    return files.select(*key, F.sha2("content", 256).alias("sha256")).join(counted, key, "left").fillna(0, ["n"])


def outside_of(text: str, spans: list[tuple[int, int]]) -> str:
    """Hash of what lies between spans in order, before the first and after the last one; blanks as one."""
    starts, ends = [0, *(e for _, e in spans)], [*(b for b, _ in spans), len(text)]
    rest = "".join(text[a:b] for a, b in zip(starts, ends))
    return hashlib.sha256(re.sub(r"\s+", " ", rest, flags=re.ASCII).strip(" ").encode()).hexdigest()


def outside_fingerprint(files: DataFrame, resources: DataFrame) -> DataFrame:
    """One hash of each file's text outside its resource blocks, blanks as one: repository, revision, relative_path, outside.

    ``resources`` has span_start and span_end, in characters; what lies between the
    spans, before the first and after the last one is the rest.  A file is cut in one pass, as finding
    a place in a text takes time by its distance from the start.
    """
    return _fingerprints(files, resources, F.lit(True)).drop("digest")


def _fingerprints(files: DataFrame, resources: DataFrame, whose: Column) -> DataFrame:
    """Of each file the hash of its content (digest), and of those files ``whose`` is true that of the text outside resources (outside)."""
    key = ["repository", "revision", "relative_path"]
    spans = resources.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("spans"))
    text = F.coalesce("content", F.lit(""))
    both = files.select(*key, F.sha2(text, 256).alias("digest"), F.when(whose, text).alias("content")).join(spans.hint("merge"), key, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *same, content, spans = batch.columns
            outside = [None if (text := content[k].as_py()) is None else outside_of(text, [(x["span_start"], x["span_end"]) for x in spans[k].as_py() or ()]) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(outside, pa.string())], names=[*key, "digest", "outside"])

    kinds = dict(files.dtypes)
    return both.select(*key, "digest", "content", "spans").mapInArrow(cut, ", ".join(f"{k} {kinds[k]}" for k in key) + ", digest string, outside string")


#: file names whose change counts (lower case)
INPUTS = r"\.(tf|tfvars|tf\.json|json|yaml|yml|tpl)$|\.terraform\.lock\.hcl$"


def unclassified_file_change(files: DataFrame, resources: DataFrame, older: int, newer: int) -> DataFrame:
    """Configuration inputs that changed between two revisions in a way no resource shows: repository, relative_path, change, mixed.

    A file counts if its content differs, or it came or went, while no resource in it
    was added, removed or changed; and, ``mixed``, if a resource did change but the
    text outside all resource blocks changed as well (files of resources only).  Null
    contents count as empty.
    """
    key = ["repository", "relative_path"]
    wanted = files.filter(F.lower("relative_path").rlike(INPUTS) & F.col("revision").isin(older, newer))
    # files are read once; what is staged has no text
    prints = staged(_fingerprints(wanted, resources, F.lower("relative_path").endswith(".tf")), "fingerprints")
    side = lambda r, n, o: prints.filter(F.col("revision") == r).select(*key, F.col("digest").alias(n), F.col("outside").alias(o))
    both = side(older, "a", "x").join(side(newer, "b", "y"), key, "full_outer")
    changed = both.withColumn("change", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")).filter("change is not null")
    # resources that one revision holds more often than the other
    times = lambda r: F.count(F.when(F.col("revision") == r, 1))
    same = resources.filter(F.col("revision").isin(older, newer)).select(*key, *IDENTITY[1:], "content_hash", _canonical("annotations").alias("notes"), _canonical("tags").alias("tags"), "revision").groupBy(*key, *IDENTITY[1:], "content_hash", "notes", "tags")
    moved = same.agg(times(older).alias("then"), times(newer).alias("now")).filter("then <> now").select(*key).distinct().withColumn("moved", F.lit(True))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    seen = changed.join(moved, key, "left")
    apart = F.coalesce("x", empty) != F.coalesce("y", empty)
    return seen.filter(F.col("moved").isNull() | apart).select(*key, "change", F.col("moved").isNotNull().alias("mixed"))


def history_gaps(needed: DataFrame, available: DataFrame) -> DataFrame:
    """Revisions of ``needed(target, repository, revision)`` that are not available: a high gap each, never a partial comparison."""
    gone = needed.join(available.select("repository", "revision").distinct(), ["repository", "revision"], "left_anti")
    return gone.select("target", "repository", "revision", F.lit("history_unavailable").alias("kind"), F.lit("high").alias("severity"))


def unpinned_inputs(observed: DataFrame, committed: DataFrame) -> DataFrame:
    """Inputs whose observed digest is not the committed one, by (repository, revision, path): missing, untracked, different or symlink.

    ``observed`` and ``committed`` have digest and is_link; a link is reported as such first.
    """
    key = ["repository", "revision", "path"]
    o, c = (t.select(*key, F.col("digest").alias(f"{n}_digest"), F.col("is_link").alias(f"{n}_link"), F.lit(True).alias(n)) for t, n in ((observed, "o"), (committed, "c")))
    both = o.join(c, key, "full_outer")
    state = F.when(F.coalesce("o_link", F.lit(False)) | F.coalesce("c_link", F.lit(False)), "symlink").when(F.col("o").isNull(), "missing").when(F.col("c").isNull(), "untracked").when(~F.col("o_digest").eqNullSafe(F.col("c_digest")), "different")
    return both.select(*key, state.alias("state")).filter("state is not null")
