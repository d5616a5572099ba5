"""SQL that the queries of this subpackage are checked against."""

from kotonoha.llm.license_scan import TEMPLATES

URL_ORACLE = r"""
with parsed as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
numbered as (
  select page_id, try_cast(nullif(regexp_extract(path, '/(\d{1,18})(?:/|\.html)?$', 1), '') as bigint) as number from parsed),
outcomes as (
  select page_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null then 0 end) as bad
  from numbered join labels on number = doc_id where page_id is not null group by page_id),
counts as (
  select host, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad,
    list_extract(string_split(host, '.'), -1) as suffix,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain
  from parsed left join outcomes using (page_id) group by host),
base as (select (sum(bad) + 1.0) / (sum(n) + 2.0) as base from counts),
suffixes as (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from counts group by suffix),
domains as (select suffix, domain, sum(n)::bigint as n, sum(bad)::bigint as bad from counts group by suffix, domain),
children as (
  select 'top' as level, 'all' as parent, n, bad from suffixes where n > 0
  union all select 'suffix', suffix, n, bad from domains where n > 0
  union all select 'domain', domain, n, bad from counts where n > 0),
moments as (
  select level, parent, count(*) as k, sum(n)::double as sn, sum(n * n)::double as snn, sum(bad)::double as sb,
    sum((bad * bad)::double / n) as sbb
  from children group by level, parent),
spread as (
  select level, parent, k, (sb / sn) * (1 - sb / sn) as noise, sn - snn / sn as weight,
    case when sn - snn / sn > 0 then (sbb - sn * (sb / sn) * (sb / sn) - (k - 1) * ((sb / sn) * (1 - sb / sn))) / (sn - snn / sn) end as between_
  from moments),
strengths as (
  select level, parent, case when k < 2 or weight <= 0 or noise <= 0 or between_ <= 0 then 1000.0::double
    else least(1000.0, greatest(1.0, noise / between_ - 1)) end as strength
  from spread),
at_suffix as (
  select suffix, (bad + s * base) / (n + s) as suffix_mean
  from suffixes, base, (select coalesce(max(strength) filter (level = 'top'), 1000.0) as s from strengths)),
at_domain as (
  select domain, (d.bad + coalesce(strength, 1000.0) * suffix_mean) / (d.n + coalesce(strength, 1000.0)) as domain_mean
  from domains d join at_suffix using (suffix) left join strengths s on s.level = 'suffix' and s.parent = d.suffix),
posterior as (
  select host, n, bad + coalesce(strength, 1000.0) * domain_mean as a, n - bad + coalesce(strength, 1000.0) * (1 - domain_mean) as b
  from counts c join at_domain using (domain) left join strengths s on s.level = 'domain' and s.parent = c.domain),
hosts as (
  select host, n, a / (a + b) as mean, greatest(0.0, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) as lower_
  from posterior),
rules(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
select page_id, host, path, hit.rule as rule,
  coalesce(hit.verdict, case when lower_ > 0.5 then 'block' else 'allow' end) as verdict,
  n as n_labelled, round(mean, 6) as bad_rate, round(lower_, 6) as bad_rate_lower
from (
  select p.*, (select max({'size': length(rule_host) + length(rule_path), 'rule': rule_host || rule_path, 'verdict': rule_verdict})
    from rules where (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)) as hit
  from parsed p) join hosts using (host)
"""

_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))

LICENSE_ORACLE = rf"""
with texts as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
words as materialized (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from texts),
near as (
  select doc_id, i, word as a, lead(word) over d as b, lead(word, 2) over d as c, lead(word, 3) over d as e
  from words window d as (partition by doc_id order by i)),
four as materialized (select * from near where a in (select unnest(string_split(text, ' ')) from (values {_TEMPLATE_ROWS}) t(template, label, text))),
base as (
  select doc_id, i, case when a = 'mit' and b = 'license' then 'mit' when a = 'apache' and b = 'license' then 'apache'
    when a = 'general' and b = 'public' and c = 'license' then 'gpl' end as label from four),
base_docs as (
  select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list(distinct label)) as labels
  from base where label is not null group by doc_id),
templates as (select template, label, string_split(text, ' ') as w from (values {_TEMPLATE_ROWS}) t(template, label, text)),
grams as (
  select template, p, w[p + 1] as a, w[p + 2] as b, w[p + 3] as c, w[p + 4] as e
  from (select template, w, unnest(range(len(w) - 3)) as p from templates)),
votes as (select distinct doc_id, template, i - p as diagonal, i, p from four join grams using (a, b, c, e)),
diagonals as (select distinct doc_id, template, diagonal from votes),
cut as (
  select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= 2 then 0 else 1 end as new_ from diagonals),
clusters as (select *, sum(new_) over (partition by doc_id, template order by diagonal rows unbounded preceding) as cluster from cut),
covered as (
  select doc_id, template, cluster, min(i) as first_, max(i + 3) as last_, count(distinct q) as words_
  from (select doc_id, template, cluster, i, unnest(range(p, p + 4)) as q from votes join clusters using (doc_id, template, diagonal))
  group by doc_id, template, cluster),
spans as (
  select doc_id, label, words_ / len(w) as share from covered join templates using (template)
  where words_ / len(w) >= 0.8 and last_ - first_ + 1 <= 1.5 * len(w)),
found as (select doc_id, list(distinct label) as labels, max(share) as share from spans group by doc_id)
select t.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(b.labels, ','), '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') as labels,
  coalesce(share, case when n_base > 0 then 0.5 end, 0.0)::double as score
from texts t left join base_docs b using (doc_id) left join found f using (doc_id)
"""

JACCARD_ORACLE = r"""
with recursive texts as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as materialized (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), chr(1)) as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from texts where len(w) > 0)),
sizes as materialized (select doc_id, count(*) as n, md5(string_agg(s, chr(2) order by s)) as content from shingles group by doc_id),
classes as materialized (select content, any_value(n) as n, min(doc_id) as class_id, count(*) as class_size from sizes group by content),
members as materialized (select s.doc_id, s.s, n from shingles s join classes on class_id = doc_id),
counts as materialized (select s, count(*) as c from members group by s having count(*) > 1),
-- pairs share a shingle that is among the rarest quarter of either set
ranked as materialized (
  select doc_id, s, n, row_number() over (partition by doc_id order by coalesce(c, 1), s) as r from members left join counts using (s)),
firsts as materialized (select doc_id, s from ranked where r <= n - (n * 75 + 99) // 100 + 1 and s in (select s from counts)),
pairs as materialized (select distinct a.doc_id as a, b.doc_id as b from firsts a join firsts b on a.s = b.s and a.doc_id < b.doc_id),
links as materialized (
  select a, b from (select a, b, count(*) as both_ from pairs join members x on x.doc_id = a join members y on y.doc_id = b and y.s = x.s group by a, b)
  join classes x on x.class_id = a join classes y on y.class_id = b where 100 * both_ >= 75 * (x.n + y.n - both_)),
edges as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select class_id, class_id from classes union select r.a, e.b from reach r join edges e on e.a = r.b),
named as (select a, min(b) as component_id from reach group by a)
select t.doc_id, coalesce(sizes.n, 0)::bigint as n_shingles, coalesce(component_id, t.doc_id) as component_id,
  coalesce(class_id, t.doc_id) as class_id, coalesce(class_size, 1)::bigint as class_size
from texts t left join sizes using (doc_id) left join classes using (content) left join named on a = class_id
"""


def _crc32(text: str) -> str:
    """The CRC of a short ASCII text, bit by bit."""
    step = "case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end"
    each = f"lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda t: ascii(t)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), {each}), 4294967295::bigint)"


WARC_ORACLE = r"""
with rows as (
  select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
placed as (
  select *, row_number() over (partition by html order by page_id nulls last) as place, min(page_id) over (partition by html) as first_id from rows)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and place > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and place > 1 then first_id end as refers_to
from placed
"""

# a path is a text of pairs: the edit's initial, and the state it leads to (the row's own for a deletion)
CONVERSATION_ORACLE = rf"""
with recursive damaged as materialized (
  select conv_id, turn, kind, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
    case kind when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text
  from (select *, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations)),
kept as (
  select conv_id, turn, role, text from damaged where kind > 0 union all select conv_id, turn, role, text from damaged where kind = 3),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from kept),
marked as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') as cut, left(role, 1) as initial,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair
  from placed),
rows as materialized (
  select conv_id, i, turn, role, text, initial, pair, blank, again and not blank as duplicate, cut and not again and not blank as truncated, blank or again as gone from marked),
-- the least (cost, path) in each state, the cost as five digits before the path; '~' where a state is not reached
-- A conversation without rows has the one at the start; inserts are taken at every place
walk(conv_id, i, q, s, u, a) as (
  select distinct conv_id, 0::bigint, '00000', '~', '00002Iu', '00004IuIa' from damaged
  union all
  select w.conv_id, w.i + 1, nq, ns, nu_, least(na, case when nu_ < '~' then {{plus_nu}} else '~' end)
  from (
    select w.conv_id, w.i, nq, ns, na, least(nu, case when nq < '~' then {{plus_nq}} else '~' end, case when ns < '~' then {{plus_ns}} else '~' end, case when na < '~' then {{plus_na}} else '~' end) as nu_
    from (
      select w.conv_id, w.i,
        {{d_q}} as nq,
        least({{d_s}}, {{k_q_s}}) as ns,
        least({{d_u}}, {{k_q_u}}, {{k_s_u}}, {{k_a_u}}, {{r_q_u}}, {{r_s_u}}, {{r_a_u}}) as nu,
        least({{d_a}}, {{k_u_a}}, {{r_u_a}}) as na
      from walk w join rows r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1) w) w),
final as (
  select conv_id, least(q, a) as best from walk w qualify row_number() over (partition by conv_id order by i desc) = 1),
edits as (
  select conv_id, best, j, best[6 + 2 * j] as edit, best[7 + 2 * j] as state,
    sum(case when best[6 + 2 * j] <> 'I' then 1 else 0 end) over (partition by conv_id order by j) as i
  from (select conv_id, best, unnest(range((length(best) - 5) // 2)) as j from final)),
repaired as (
  select e.conv_id, string_agg(edit, '' order by j) as audit,
    string_agg(case edit when 'K' then r.role else case state when 'u' then 'user' else 'assistant' end end || ':' || case edit when 'I' then '' else r.text end,
      chr(10) order by j) filter (where edit <> 'D') as text
  from edits e left join rows r on r.conv_id is not distinct from e.conv_id and r.i = e.i group by e.conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
    count(*) filter (truncated) as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal
  from rows group by conv_id)
select f.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, left(best, 5)::bigint as cost, coalesce(audit, '') as audit,
  sha256(coalesce(p.text, '')) as repaired_sha256
from final f left join counts c on c.conv_id is not distinct from f.conv_id left join repaired p on p.conv_id is not distinct from f.conv_id
"""


def _plus(column: str, cost: str, step: str) -> str:
    return f"printf('%05d', left({column}, 5)::bigint + {cost}) || substr({column}, 6) || {step}"


def _arc(column: str, when: str, cost: str, step: str) -> str:
    return f"case when w.{column} < '~' and {when} then {_plus('w.' + column, cost, step)} else '~' end"


def _conversation_sql(text: str) -> str:
    parts = {f"plus_{c}": _plus(c, "2", "'Ia'" if c == "nu" else "'Iu'") for c in ("nq", "ns", "na", "nu")}
    parts["plus_nu"] = parts["plus_nu"].replace("(nu,", "(nu_,")
    for state in "qsua":
        parts[f"d_{state}"] = _arc(state, "true", "3", "'D-'")
        for to in "sua":
            parts[f"k_{state}_{to}"] = _arc(state, f"not gone and initial = '{to}'", "case when truncated then 1 else 0 end", f"'K{to}'")
            parts[f"r_{state}_{to}"] = _arc(state, "not gone", "case when truncated then 3 else 2 end", f"'R{to}'")
    for name, value in parts.items():
        text = text.replace("{" + name + "}", value)
    return text


CONVERSATION_ORACLE = _conversation_sql(CONVERSATION_ORACLE)


def _encoded(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"


# a tree is a row per level with the list of its nodes; a node's siblings are those of its pair
MERKLE_ORACLE = rf"""
with recursive leaves as materialized (
  select doc_id, coalesce('=' || lang, '') as grp, {_leaf("n_chars")} as leaf,
    case when {_crc32("doc_id::varchar")} % 7 = 0 then {_leaf("(n_chars + 1)")} else {_leaf("n_chars")} end as start
  from documents),
placed as materialized (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as slot from leaves),
tree(grp, level, nodes) as (
  select grp, 0, list(leaf order by slot) from placed group by grp
  union all
  select grp, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from tree where len(nodes) > 1),
subroots as materialized (select grp, nodes[1] as subroot, row_number() over (order by grp) - 1 as place from tree where len(nodes) = 1),
crown(level, nodes) as (
  select 0, list(subroot order by place) from subroots
  union all
  select level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) from crown where len(nodes) > 1),
climb(doc_id, grp, leaf, slot, level, h, proof) as (
  select doc_id, grp, leaf, slot, 0, start, '' from placed
  union all
  select c.doc_id, c.grp, c.leaf, c.slot, c.level + 1,
    sha256(case when (c.slot >> c.level) % 2 = 1 then nodes[(c.slot >> c.level)] || h else h || coalesce(nodes[(c.slot >> c.level) + 2], '') end),
    proof || case when (c.slot >> c.level) % 2 = 1 then nodes[(c.slot >> c.level)] else coalesce(nodes[(c.slot >> c.level) + 2], '') end
  from climb c join tree t on t.grp = c.grp and t.level = c.level where len(nodes) > 1),
at_group as (
  select c.*, subroot, place from climb c join (select grp, max(level) as top from tree group by grp) m on m.grp = c.grp and m.top = c.level join subroots s on s.grp = c.grp),
climb_on(doc_id, leaf, subroot, place, level, h, proof) as (
  select doc_id, leaf, subroot, place, 0, h, proof from at_group
  union all
  select doc_id, leaf, subroot, place, c.level + 1,
    sha256(case when (place >> c.level) % 2 = 1 then nodes[(place >> c.level)] || h else h || coalesce(nodes[(place >> c.level) + 2], '') end),
    proof || case when (place >> c.level) % 2 = 1 then nodes[(place >> c.level)] else coalesce(nodes[(place >> c.level) + 2], '') end
  from climb_on c join crown t on t.level = c.level where len(nodes) > 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
from climb_on, (select max(level) as top, max(nodes[1]) filter (where len(nodes) = 1) as root from crown) where level = top
"""
