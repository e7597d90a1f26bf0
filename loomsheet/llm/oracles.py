"""What some of the operators return, in DuckDB's SQL."""

from __future__ import annotations

from loomsheet.llm.secret_scan import RULES, Rule

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

REPEATS = """
with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
starts as (select r, unnest(range(1, length(x) // 2 - 398)) as i from docs where length(x) >= 800),
strings as (select r, i, md5(substr(x, 2 * i - 1, 800)) as s from starts join docs using (r)),
again as (select s from strings group by s having count(*) > 1),
hit as (select r, i from strings join again using (s)),
runs as (
  select r, min(i) as lo, max(i) + 400 as hi from (
    select r, i, sum(fresh) over (partition by r order by i) as g from (
      select r, i, case when i - lag(i) over (partition by r order by i) <= 400 then 0 else 1 end as fresh from hit))
  group by r, g),
gone as (select r, lo, hi, lag(hi, 1, 1) over (partition by r order by lo) as after from runs),
kept as (
  select r, string_agg(substr(x, 2 * after - 1, 2 * (lo - after)), '' order by lo) as head,
    max(hi) as last, sum(hi - lo)::bigint as n_removed, count(*) as n_spans
  from gone join docs using (r) group by r)
select doc_id, (length(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 1) - 1))) as kept_sha256,
  coalesce(n_removed, 0) > 0 as repeated
from docs left join kept using (r)
"""

WINNOW = f"""
with items as (
  select coalesce(cast(item_id as varchar), 'null') as item, {WORDS.format("coalesce(text, '')")} as w from benchmark),
sized as (select item, w, least(len(w), 10) as n from items where len(w) > 0),
runs as (
  select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as run
  from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
docs as (select row_number() over () as r, doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
places as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as run
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from runs))),
met as (select r, n, i, item from places join runs using (n, run)),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from met) group by r),
named as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from met) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (r) left join named using (r)
"""


def _matches(rule: Rule, order: int) -> str:
    """The checked matches of a rule: pieces between matches and the matches, summed up to their places."""
    regex = "'" + rule.regex.replace("'", "''") + "'"
    return f"""
  select r, {order} as kind_order, '{rule.kind}' as kind, finish - size as start, finish, {str(rule.base).lower()} as base from (
    select r, g, size, (sum(length(p) + size) over (partition by r order by j))::bigint as finish from (
      select r, generate_subscripts(m, 1) as j, unnest(m) as one, length(one) as size, unnest(p[1:len(m)]) as p, unnest(g) as g
      from (select r, regexp_extract_all(x, {regex}) as m, string_split_regex(x, {regex}) as p,
        regexp_extract_all(x, {regex}, {rule.group}) as g from docs)))
  where length(g) >= {rule.least}"""


def secrets(rules: tuple[Rule, ...] = RULES) -> str:
    base = [r.kind for r in rules if r.base]
    spans = " union all ".join(_matches(r, i) for i, r in enumerate(rules))
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in base)
    given = ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in base)
    listed = "string_agg(kind || ':' || start || ':' || finish, ',' order by start, kind_order)"
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
spans as ({spans}),
found as (select r, {counts}, {listed} filter (base) as base_list, {listed} as spans from spans group by r)
select doc_id, {given}, sha256(coalesce(base_list, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join found using (r)
"""


JACCARD = f"""
with recursive words as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
sized as (select doc_id, w, least(len(w), 5) as n from words where len(w) > 0),
sets as (
  select distinct doc_id, array_to_string(w[i:i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
sizes as (select doc_id, count(*) as n, md5(string_agg(s, '|' order by s)) as k from sets group by 1),
classes as (select k, min(doc_id) as copy_id, count(*) as n_copies from sizes group by 1),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where common >= 0.8 * (x.n + y.n - common)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, least(a, min(b)) as class_id from reach group by 1),
degree as (select a, count(*) as n_links from links group by 1)
select w.doc_id, coalesce(class_id, w.doc_id) as class_id, coalesce(copy_id, w.doc_id) as copy_id,
  coalesce(n_copies, 1) as n_copies, coalesce(n_links, 0) as n_links
from words w left join least l on l.a = w.doc_id left join degree d on d.a = w.doc_id
  left join sizes s on s.doc_id = w.doc_id left join classes c on c.k = s.k
"""
