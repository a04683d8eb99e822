"""DuckDB SQL with the rows of the corpus queries that SQL can express."""

from __future__ import annotations

from . import mixing, urls

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATE = f"""
with dw as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bi as (select item_id, w, least(8, len(w)) as k from bw where len(w) > 0),
items as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as win from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from bi)),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from dw where len(w) > 0),
wins as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as win from places, (select distinct k from items) s where i + k - 1 <= len(w)),
hits as (select doc_id, i, wins.k, item_id from wins join items on wins.k = items.k and wins.win = items.win),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id, cast(item_id as varchar) as item from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from dw left join words on words.doc_id = dw.doc_id left join found on found.doc_id = dw.doc_id
"""


def url_filter() -> str:
    fits = []
    for r in urls.RULES:
        fits.append(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')")
    ordered = [fits[k] for k in sorted(range(len(fits)), key=lambda k: -len(urls.RULES[k].name))]
    rules = sorted(urls.RULES, key=lambda r: -len(r.name))
    names = " ".join(f"{w} then '{r.name}'" for w, r in zip(ordered, rules, strict=True))
    verdicts = " ".join(f"{w} then '{r.verdict}'" for w, r in zip(ordered, rules, strict=True))
    near = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    strict = " or ".join(map(near, urls.STRICT))
    soft = " + ".join(f"cast({near(t)} as int)" for t in urls.SOFT)
    return f"""
with u as (select page_id, coalesce(url, '') as url, instr(coalesce(url, ''), '://') as mark from pages),
r as (select page_id, {_LOWER.format("url")} as low, case when mark > 0 then substr(url, mark + 3) else '' end as rest from u),
h as (select page_id, low, regexp_extract(rest, '^([^/?#]*)', 1) as raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
p as (select page_id, low, {_LOWER.format("raw")} as host, path from h)
select page_id, host, path, case {names} end as rule, case {verdicts} when {strict} or {soft} >= {urls.SOFT_LIMIT} then 'block' else 'allow' end as verdict from p
"""


def source_mix(seed: str = "mix-1") -> str:
    ws = ", ".join(f"cast({w} as double)" for w in mixing.WEIGHTS)
    return f"""
with d as (select doc_id, source, {_WHITE_WORDS.format("coalesce(text, '')")} as w, coalesce(text, '') as t from documents),
k as (select doc_id, source, cast(len(w) as bigint) as size, len(list_distinct(w)) as n, length(regexp_replace(t, '[^#*$%&|<>!]+', '', 'g')) as marks, length(t) as chars,
  (cast(cast('0x' || substr(md5(cast(doc_id as varchar) || ':{seed}'), 1, 12) as bigint) as double) + 0.5) / cast({1 << 48} as double) as u from d),
m as (select *, case when size < 20 then 1.0::double else ln(n + 1.0::double) / ln(size + 1.0::double) end as variety from k),
q as (select doc_id, source, size, -ln(u) / (greatest({mixing.WEAKEST}::double, least(1.0::double, 1.0::double - 7.5::double * marks / greatest(chars, 1)))
  * greatest({mixing.WEAKEST}::double, least(1.0::double, (variety - 0.4::double) / 0.3::double))) as key from m),
s as (select source, cast(sum(size) as bigint) as source_size from q group by source),
w as (select source, source_size, [{ws}][(row_number() over (order by source is null, source) - 1) % {len(mixing.WEIGHTS)} + 1] as w from s),
c as (select source, source_size, w, {float(mixing.EPOCHS)}::double * source_size as cap, {float(mixing.EPOCHS)}::double * source_size / w as r from w),
l as (select source, source_size, w, cap, r, cast((select sum(source_size) from s) as double) - coalesce(sum(cap) over (order by r, source is null, source rows between unbounded preceding and 1 preceding), 0) as lft,
  sum(w) over (order by r, source is null, source rows between current row and unbounded following) as wleft from c),
v as (select lft / wleft as level from l where lft / wleft <= r order by r, source is null, source limit 1),
g as (select source, source_size, least(cap, w * coalesce((select level from v), 0)) as target from l),
e as (select q.doc_id, q.size, g.source_size, g.target, q.key, cast(floor(g.target + 1e-6) as bigint) as whole,
  coalesce(sum(q.size) over (partition by q.source order by q.key, q.doc_id, q.size rows between unbounded preceding and 1 preceding), 0) as before from q join g on q.source is not distinct from g.source),
f as (select *, case when source_size > 0 then whole // source_size else 0 end as epochs from e)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, whole - epochs * source_size - before)) as bigint) as taken from f
"""


NEAR_DEDUP = f"""
with recursive dw as (select doc_id, {_WHITE_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents),
sh as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from dw where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
common_ as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common_ join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
both_ as (select x, y from links union all select y, x from links),
reach(a, b) as (select doc_id, doc_id from dw union select reach.a, both_.y from reach join both_ on both_.x = reach.b)
select dw.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, dw.doc_id = c.component_id as kept
from dw left join n on n.doc_id = dw.doc_id join (select a, min(b) as component_id from reach group by a) c on c.a = dw.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": DECONTAMINATE, "op3_url_filter": url_filter(), "op9_source_mix": source_mix(), "op10_near_dedup": NEAR_DEDUP}
