"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import fill_in_middle as fim
from . import hard_negatives as hn
from . import quality_rules as q
from . import topk

QUALITY_RULES = rf"""
with words as (
  select doc_id, source, text, row_number() over () as row_id,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws
  from documents),
windows as (
  select row_id, i, array_to_string(ws[i:i+{q.WINDOW - 1}], ' ') as g
  from (select row_id, ws, unnest(generate_series(1, len(ws) - {q.WINDOW - 1})) as i from words where len(ws) >= {q.WINDOW})),
repeated as (
  select row_id, i from (select row_id, i, count(*) over (partition by row_id, g) as n from windows) where n >= 2),
covered as (
  select row_id, count(distinct p) as n
  from (select row_id, unnest(generate_series(i, i + {q.WINDOW - 1})) as p from repeated) group by row_id),
lines as (
  select row_id, count(*) - count(distinct line) as n
  from (select row_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from words)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by row_id),
rules as (
  select w.row_id, doc_id, len(ws) as n_words,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '{q.SYMBOLS}', '', 'g')) as n_symbols,
         coalesce(l.n, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
         nullif(regexp_extract(lower(trim(source)), '^(?:[a-z][a-z0-9+.\-]*://)?(?:[^/@?#]*@)?([^/:?#]*)', 1), '') as host
  from words w left join covered c using (row_id) left join lines l using (row_id)),
judged as (
  select *, n_words < {q.MIN_WORDS} or n_repeat_words * 100 > n_words * {q.REPEAT_PERCENT} as base_failed from rules),
hosts as (
  select host, count(*)::double as n_docs, sum(base_failed::int)::double as n_failed from judged where host is not null group by host),
moments as (select avg(n_failed / n_docs) as m, var_pop(n_failed / n_docs) as v, avg(1 / n_docs) as q from hosts),
shares as (select m, case when m * (1 - m) > 0 and q < 1 then (v / (m * (1 - m)) - q) / (1 - q) else 0.0::double end as share from moments),
prior as (select m, case when share > 0 then greatest(1 / share - 1, 1.0::double) else {q.WEAK_PRIOR}::double end as strength from shares),
verdicts as (
  select host, (n_failed + m * strength) / (n_docs + strength) > {q.MAX_HOST_RATE}::double as host_failed from hosts, prior)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and not coalesce(host_failed, false) as kept
from judged left join verdicts using (host)
"""


#: Rows of embeddings that take part, each component as a whole number of 256ths.
SCALED = "list_transform(embedding, lambda x: floor(x::double * 256)::bigint)"
WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
INNER = "list_sum(list_transform(list_zip(q.x, r.x), lambda p: p[1] * p[2]))::bigint"

TOPK = rf"""
with v as (select vec_id, {SCALED} as x from embeddings where vec_id is not null and {WHOLE}),
s as (select q.vec_id as query_id, r.vec_id, coalesce({INNER}, 0) as score
      from v q join v r on q.vec_id <> r.vec_id and len(q.x) = len(r.x) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= {topk.K}
"""

HARD_NEGATIVES = rf"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {SCALED} as x
           from embeddings where vec_id is not null and label is not null and {WHOLE}),
s as (select q.vec_id as anchor_id, r.vec_id, q.label = r.label as same, coalesce({INNER}, 0) as score
      from v q join v r on q.vec_id <> r.vec_id and len(q.x) = len(r.x) where q.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score
      from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= {hn.POSITIVES}),
w as (select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
             row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
      from p join s using (anchor_id)
      where not same and {hn.LOW} * positive_score <= 100 * score and 100 * score <= {hn.HIGH} * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from w where rank <= {hn.K}
"""

FILL_IN_MIDDLE = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (select *, len(u) as n, ('0x' || h[1:8])::ubigint as h1, ('0x' || h[9:16])::ubigint as h2, ('0x' || h[17:24])::ubigint as h3, ('0x' || h[25:32])::ubigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= {fim.RATE} then 'plain'
                  when h4 % 100 < {fim.SUFFIX_FIRST} then 'spm' else 'psm' end as form from g),
s as (select doc_id, n, form, text, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from s
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": QUALITY_RULES, "op9_topk": TOPK, "op11_hard_negatives": HARD_NEGATIVES, "op12_fill_in_middle": FILL_IN_MIDDLE}
