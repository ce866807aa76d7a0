"""SQL that rebuilds the statement tables in the checking engine, as named steps of one WITH clause."""

from __future__ import annotations

from ..functions import rules
from ..functions.dialect import DUCK
from ..sources import corpus

_D = "doc_id, version_ord"
_OVER = f"(partition by {_D} order by line_ord rows between unbounded preceding and current row)"
_ALL = f"(partition by {_D} order by line_ord)"
_MODAL = lambda x: rules.has_modal(DUCK, x)


def _steps() -> dict[str, str]:
    classified = ", ".join(f"{v} as {k}" for k, v in rules.classify(DUCK, "clause", "verbs", "framework_ids").items())
    return {
        "pol": corpus.policy_sql(),
        "lines": f"select {_D}, line_ord, line, cast(sum(length(line) + 1) over {_OVER} - length(line) - 1 as bigint) as \"offset\" from (select {_D}, unnest(l) as line, generate_subscripts(l, 1) - 1 as line_ord from (select {_D}, string_split(markdown, chr(10)) as l from pol))",
        "fenced": f"select *, trim(line) like '```%' as fence, sum(case when trim(line) like '```%' then 1 else 0 end) over {_OVER} % 2 = 1 as inside from lines",
        "kinds": r"""select * from (select *, case when fence then 'fence' when inside then 'fenced' when regexp_matches(line, '(?i)<!--\s*Page\s+\d+\s*-->') then 'page'
            when regexp_matches(line, '^#{1,6}\s+.*$') then 'heading' when trim(line) = '' then 'blank' when trim(line) like '|%|' then 'table'
            when regexp_matches(line, '^\s*(?:[-*+] |\d+[.)]\s+).+$') then 'bullet' else 'prose' end as kind from fenced) where kind <> 'fenced'""",
        "heads": rf"""select {_D}, line_ord, line, "offset", kind, last_value(case when kind = 'page' then cast(regexp_extract(line, '(\d+)', 1) as integer) end ignore nulls) over {_OVER} as page,
            list(case when kind = 'heading' then {{'level': length(regexp_extract(line, '^(#+)', 1)), 'title': trim(regexp_extract(line, '^#+\s+(.*)$', 1))}} end) over {_OVER} as heads from kinds""",
        "structured": f"""select {_D}, line_ord, line, "offset", kind, page, list_reduce(list_concat([cast([] as varchar[])], list_transform(list_filter(heads, lambda h: h is not null), lambda h: list_concat([cast(h.level as varchar)], [h.title]))),
            lambda p, h: list_concat(p[1:cast(h[1] as integer) - 1], [h[2]])) as heading_path from heads""",
        "tables": rf"""select *, list_transform(string_split(regexp_replace(trim(line), '^\|+|\|+$', '', 'g'), '|'), lambda c: regexp_replace(trim(c), '(?i)<br\s*/?>', '; ', 'g')) as cells from
            (select *, sum(case when kind is distinct from previous then 1 else 0 end) over {_OVER} as run from (select *, lag(kind) over {_ALL} as previous from structured)) where kind = 'table'""",
        "ruled": rf"select *, len(list_filter(cells, lambda c: not regexp_matches(c, '^:?-{{3,}}:?$'))) = 0 as rule from tables",
        "rows_": f"""select {_D}, line_ord, array_to_string(list_filter(cells, lambda c: c <> ''), ' | ') as text, "offset" + greatest(instr(line, list_extract(list_filter(cells, lambda c: c <> ''), 1)) - 1, 0) as start, heading_path, page
            from (select *, max(case when rule then 1 else 0 end) over (partition by {_D}, run order by line_ord rows between unbounded preceding and current row) as body from ruled) where body = 1 and not rule""",
        "marked": f"""select *, lead(kind) over {_ALL} as "after", sum(case when kind = 'bullet' or (kind = 'prose' and coalesce(previous, '') not in ('prose', 'bullet')) then 1 else 0 end) over {_OVER} as block,
            sum(case when kind in ('fence', 'page', 'heading', 'table') then 1 else 0 end) over {_OVER} as stops,
            case when kind = 'bullet' then trim(regexp_extract(line, '^\\s*(?:[-*+] |\\d+[.)]\\s+)(.+)$', 1)) else trim(line) end as body
            from (select *, lag(kind) over {_ALL} as previous from structured)""".replace("\\\\", "\\"),
        "blocks0": f"""select {_D}, block, min(line_ord) as line_ord, string_agg(body, ' ' order by line_ord) as text, arg_min("offset" + greatest(instr(line, body) - 1, 0), line_ord) as start, arg_min(kind = 'bullet', line_ord) as bullet,
            arg_min(heading_path, line_ord) as heading_path, arg_min(page, line_ord) as page, arg_min(stops, line_ord) as stops, last("after" order by line_ord) as "after" from marked where kind in ('prose', 'bullet') group by {_D}, block""",
        "leads": f"select *, text like '%:' and modal and coalesce(\"after\" in ('blank', 'bullet'), false) as lead_ from (select *, {_MODAL('text')} as modal from blocks0)",
        "islands": f"""select *, sum(case when reset then 1 else 0 end) over {_OVER} as island from (select *, coalesce(not bullet or lag(stops) over {_ALL} <> stops or (not coalesce(lag(lead_) over {_ALL}, false) and coalesce(lag("after") over {_ALL} = 'blank', false)), true) as reset from leads)""",
        "active": f"""select *, last_value(case when lead_ then {{'text': trim(text[1:length(text) - 1]), 'start': start}} end ignore nulls) over (partition by {_D}, island order by line_ord rows between unbounded preceding and 1 preceding) as active from islands""",
        "blocks": f"""select {_D}, line_ord, case when use then active.text || ' ' || text else text end as text, case when use then active.start else start end as start, heading_path, page from (select *, bullet and active is not null and not modal as use from active where not lead_)
            union all select {_D}, line_ord, text, start, heading_path, page from rows_""",
        "sentences": rf"""select *, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as sent_ord from (select *, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9("\x27])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 12) as s from blocks)""",
        "units": f"""select * exclude (u), unnest(u) as unit, generate_subscripts(u, 1) - 1 as unit_ord from (select *, case when plain like '% | %' and len(list_filter(string_split(plain, ' | '), lambda c: {_MODAL('c')})) > 1
            then list_filter(string_split(plain, ' | '), lambda c: {_MODAL('c')}) else [plain] end as u from (select * exclude (s), regexp_replace(sentence, '(?i)<br\\s*/?>', '; ', 'g') as plain from sentences))""".replace("\\\\", "\\"),
        "parts": r"select * exclude (p), unnest(p) as part, generate_subscripts(p, 1) - 1 as part_ord from (select *, list_filter(list_transform(string_split_regex(unit, '\s*;\s*|\s*,\s*(?:but|and)\s+'), lambda x: trim(x)), lambda x: x <> '') as p from units)",
        # one valid cut a part is all that this corpus has
        "pieces": rf"""select * exclude (c), unnest(c) as piece, generate_subscripts(c, 1) - 1 as piece_ord from (select *, case when {_MODAL("head_")} and {_MODAL("tail_")} then [trim(head_), trim(tail_)] else [trim(part)] end as c
            from (select *, regexp_extract(part, '(?i)^(.*?)\s+(?:and|but)\s+(.*)$', 1) as head_, regexp_extract(part, '(?i)^(.*?)\s+(?:and|but)\s+(.*)$', 2) as tail_ from parts))""",
        "owned": f"select *, {rules.shared_prefix(DUCK, 'piece')} as own from pieces",
        "clauses": f"""select *, case when not {_MODAL('piece')} and inherited is not null then inherited || ' ' || piece else piece end as clause from (select *, last_value(case when own <> '' then own end ignore nulls) over
            (partition by {_D}, line_ord, sent_ord, unit_ord order by part_ord, piece_ord rows between unbounded preceding and 1 preceding) as inherited from owned)""",
        "tagged": f"select *, {rules.verbs(DUCK, 'clause')} as verbs, {rules.control_ids(DUCK, 'clause')} as framework_ids, {rules.domains(DUCK, 'lower(clause || chr(32) || array_to_string(heading_path, chr(32)))')} as keywords from clauses where {rules.is_candidate(DUCK, 'clause')}",
        "classed": f"select *, {classified}, {rules.polarity(DUCK, 'clause', 'verbs')} as action_polarity, substr(sha256(case when len(heading_path) = 0 then clause else array_to_string(heading_path, chr(10)) || chr(10) || clause end), 1, 16) as content_hash, cast(start + greatest(instr(text, clause) - 1, 0) as bigint) as span_start from tagged",
        "firsts": f"select * exclude (confidence), case when len(keywords) > 0 then greatest(confidence, 0.78::double) else confidence end as raw, row_number() over (partition by {_D}, content_hash order by line_ord, sent_ord, unit_ord, part_ord, piece_ord) as nth from classed",
        "statements": f"""select {_D}, row_number() over (partition by {_D} order by line_ord, sent_ord, unit_ord, part_ord, piece_ord) as stmt_ord, 'pol-' || doc_id || ':' || content_hash as statement_id, trim(clause) as text, heading_path, page, statement_kind, strength, action_polarity, keywords, framework_ids,
            round(least(raw, 0.99::double), 2) as confidence, case when raw >= 0.85 then 'classified' else 'review_required' end as status, content_hash, span_start, span_start + length(clause) as span_end from firsts where nth = 1""",
    }


STEPS = _steps()


def with_steps(query: str, more: dict[str, str] | None = None) -> str:
    """``query`` after the steps that it needs (in order) and ``more`` of its own."""
    steps = STEPS | (more or {})
    needed: set[str] = set()

    def need(text: str) -> None:
        import re

        for name in steps:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(steps[name])

    need(query)
    return "with " + ",\n".join(f"{n} as materialized ({s})" if n in ("statements", "structured", "hits") else f"{n} as ({s})" for n, s in steps.items() if n in needed) + "\n" + query
