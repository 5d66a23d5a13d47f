"""The SQL that DuckDB runs beside the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, CLOSED, NAVIGATION, any_of, unspaced

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ITEMS = r"(?:\s*[|»>/·-]\s*\S+)*$"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

LINES = f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select *, translate(trim(line, {_SPACES}), {_UPPER}, {_LOWER}) as key from e),
h as (select key, min(doc_id) as first_doc from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
j as (select k.*, first_doc is not null and k.doc_id <> first_doc as dropped from k left join h using (key))
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from j group by doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


RULES = f"""
with d as (select doc_id, coalesce(text, '') as t, trim(coalesce(text, ''), {_SPACES}) as s from documents),
w as (select doc_id, t, case when s = '' then [] else regexp_split_to_array(s, '[ \\t\\n\\x0b\\f\\r]+') end as ws from d),
g as (select doc_id, array_to_string(ws[i:i+4], ' ') as win, i from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from g) where n > 1),
c as (select doc_id, count(*) as n from (select distinct doc_id, i + k as p from r, (select unnest(range(0, 5)) as k)) group by doc_id),
l as (select doc_id, line, pos, trim(line, {_SPACES}) as x from (
      select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from d)),
f as (select *, len(regexp_split_to_array(x, '[ \\t\\n\\x0b\\f\\r]+')) + len(regexp_extract_all(x, {_quoted(unspaced(''))})) as n from l),
b as (select *, x <> '' and (not regexp_matches(x, '[\\p{{L}}\\p{{N}}]')
          or (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) * 100 > length(x) * 30
          or (n <= 3 and not regexp_matches(x, {_quoted(CLOSED)}))
          or len(regexp_split_to_array(x, '\\s[|»>]\\s|\\s[|»>]$')) >= 3
          or (n <= 5 and regexp_matches(lower(x), {_quoted('^(?:' + any_of(NAVIGATION) + ')' + _ITEMS)}))
          or (n <= 25 and regexp_matches(lower(x), {_quoted(any_of(BOILERPLATE))}))) as bad from f),
a as (select doc_id, count(*) filter (x <> '') - count(distinct line) filter (x <> '') as n_dup_lines,
             count(*) filter (bad) as n_failed_lines,
             coalesce(sum(length(regexp_replace(line, '[ \\t\\n\\x0b\\f\\r]', '', 'g'))) filter (not bad), 0) as left_chars from b group by doc_id),
m as (select doc_id, len(ws) as n_words, length(regexp_replace(t, '[ \\t\\n\\x0b\\f\\r]', '', 'g')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, n_dup_lines, n_failed_lines,
             coalesce(c.n, 0) as n_repeat_words, left_chars
      from w join a using (doc_id) left join c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, n_failed_lines,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or (word_chars - left_chars) * 100 > word_chars * 50) as kept
from m
"""

ARCHIVES = """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
f as (select payload_digest, min(page_id) as first_page from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
       case when first_page is not null and first_page <> page_id then 'revisit' else 'response' end as record_type,
       case when first_page <> page_id then first_page end as refers_to, true as complete
from p left join f using (payload_digest)
"""

NEGATIVES = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
           from embeddings where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.id as anchor_id, b.id as other_id, a.label = b.label as same,
             list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::bigint as score
      from v a join v b on a.id % 50 = 0 and a.id <> b.id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (
    select p.*, other_id as negative_id, score as negative_score,
           row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank
    from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
where rank <= 3
"""

ORACLES = {"op12_hard_negatives": NEGATIVES, "op8_warc": ARCHIVES, "op7_quality_rules": RULES, "op9_line_dedup": LINES}
