"""SQL, for the checking engine, of those operators that it can express; written from the contracts, not from the operators."""

from __future__ import annotations

from . import licenses

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD = f"""with recursive w as (select doc_id, {_BLANK} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(10))) when len(w) > 0 then [array_to_string(w, chr(10))] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
links as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)),
reach as (select doc_id as a, doc_id as b from w union select r.a, l.b from reach r join links l on r.b = l.a)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id from w left join n using (doc_id) join (select a as doc_id, min(b) as c from reach group by a) using (doc_id)"""

DECONTAMINATE = f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select cast(item_id as varchar) as item, w, least(13, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
p as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as i from b)),
q as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from b) where len(w) >= n)),
h as (select doc_id, i, n, item from q join p using (n, g)),
c as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from (select distinct doc_id, i, n from h)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join t using (doc_id)"""

REPEATED_BYTES = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), l as (select doc_id, h, length(h) // 2 as n from d),
w as (select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as g from (select doc_id, h, unnest(range(0, n - 99)) as p from l where n >= 100)),
r as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) as nth from w) where nth > 1),
i as (select doc_id, p, sum(case when p <= before + 100 then 0 else 1 end) over (partition by doc_id order by p) as span from (select *, lag(p) over (partition by doc_id order by p) as before from r)),
s as (select doc_id, min(p) as a, max(p) + 100 as b from i group by doc_id, span),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as kept_from from s),
x as (select doc_id, sum(b - a) as removed, count(*) as spans, string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from k join l using (doc_id) group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from l left join x using (doc_id)"""

LINES = f"""with t as (select doc_id, unnest(l) as text, generate_subscripts(l, 1) - 1 as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
w as (select doc_id, line, list_sort(list_distinct({_BLANK})) as w from t), v as (select * from w where len(w) > 0),
s as (select w, len(w) as n, min((doc_id, line)) as first, row_number() over () as id from v group by w),
u as (select id, n, unnest(w) as word from s), f as (select word, count(*) as f from u group by word),
p as (select id, n, word from (select id, n, word, row_number() over (partition by id order by f, word) as place from u join f using (word)) where place <= n - (4 * n + 4) // 5 + 1),
c as (select distinct a.id as a, b.id as b from p a join p b using (word) where a.id < b.id and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m as (select x.id as a, y.id as b, x.first as fa, y.first as fb from c join s x on x.id = a join s y on y.id = b where 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
g as (select case when fa < fb then b else a end as id from m group by all),
o as (select v.doc_id, v.line, s.first <> (v.doc_id, v.line) or s.id in (select id from g) as gone from v join s using (w))
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_gone, 0)::bigint as n_gone, sha256(coalesce(lines, '')) as gone_sha256
from documents d left join (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_gone, string_agg(line, ',' order by line) filter (where gone) as lines from o group by doc_id) using (doc_id)"""


def license_sql() -> str:
    index = licenses.rare_word_index()
    sizes = [sum(t == k for t, _, _ in index) for k in range(len(licenses.TEMPLATES))]
    values = ", ".join(f"({t}, '{w}', {p})" for t, w, p in index)
    plates = ", ".join(f"({k}, '{label}', ' {phrase} ', {len(words.split())}, {sizes[k]}, {licenses.least_met(sizes[k])})" for k, (label, phrase, words) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in licenses.PHRASES.items())
    return f"""with d as (select doc_id, {_WORDS} as w from documents), u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from d),
x as (select * from (values {values}) t(template, word, place)), y as (select * from (values {plates}) t(template, label, phrase, size, indexed, least_)),
z as (select * from (values {phrases}) t(label, phrase, k)),
b as (select doc_id, i, label from u join d using (doc_id) join z on word = string_split(phrase, ' ')[1] where array_to_string(w[i + 1:i + k], ' ') = phrase),
v as (select doc_id, template, i - place as start, count(*) as matched from u join x using (word) group by all),
a as (select doc_id, label, matched / indexed as share from v join y using (template) join d using (doc_id) where matched >= least_ and start + size > 0 and contains(' ' || array_to_string(w[greatest(start, 0) + 1:start + size], ' ') || ' ', phrase)),
l as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from a union all select doc_id, label from b) group by doc_id),
c as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(best, case when n_base > 0 then 0.5 else 0 end)::double as score
from d left join c using (doc_id) left join l using (doc_id) left join (select doc_id, max(share) as best from a group by doc_id) using (doc_id)"""


HARD_NEGATIVES = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
t as (select * from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as nth from p where same) where nth <= 5),
n as (select t.anchor_id, t.vec_id as positive_id, cast(row_number() over (partition by t.anchor_id, t.vec_id order by p.score desc, p.vec_id) as integer) as rank, p.vec_id as negative_id, t.score as positive_score, p.score as negative_score
    from t join p on p.anchor_id = t.anchor_id and not p.same and 30 * t.score <= 100 * p.score and 100 * p.score <= 90 * t.score)
select * from n where rank <= 10"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after the other, each a step that is kept."""
    steps = [
        "e as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * x::double) as bigint)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"p as materialized (select vec_id, label, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] as v from e, (select unnest(range({parts})) as part))",
        f"k0 as materialized (select part, entry, v from p join (select vec_id, row_number() over (order by vec_id) - 1 as entry from e order by vec_id limit {entries}) using (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec_id, label, part, min(d) as d, arg_min(entry, (d, entry)) as entry from (select p.vec_id, p.label, part, entry, cast(list_sum(list_transform(list_zip(p.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d from p join k{r} k using (part)) group by all)")
        if r < rounds:
            steps.append(f"k{r + 1} as materialized (select part, entry, coalesce(m.v, k.v) as v from k{r} k left join (select part, entry, list(cast(floor(s / n) as bigint) order by place) as v from (select part, entry, place, sum(x)::double as s, count(*) as n from (select part, a.entry, unnest(p.v) as x, generate_subscripts(p.v, 1) as place from p join a{r} a using (vec_id, part)) group by all) group by part, entry) m using (part, entry))")
    return f"""with {", ".join(steps)}, c as (select vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a{rounds} group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) from k{rounds}) as codebooks_sha256 from c"""


ORACLE_SQL = {
    "op4_ngram_jaccard_join": JACCARD,
    "op6_wu_manber_decontamination": DECONTAMINATE,
    "op7_suffix_array_dedup": REPEATED_BYTES,
    "op9_license_scan": license_sql(),
    "op10_line_dedup": LINES,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_vector_codes": vector_codes_sql(),
}
