"""DuckDB SQL for the rows of the queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

from foliant.llm.mixing import MixSpec
from foliant.llm.url_filter import UrlRules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(norm) as text_sha256
from t window g as (partition by norm)
"""

TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

RANKED_SEARCH = f"""
with d as (select doc_id, {TERMS} as terms from documents),
size as (select count(*) as docs, sum(len(terms)) as words from d where len(terms) > 0),
posting as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from d) group by all),
asked as (select distinct item_id, term from (select item_id, unnest({TERMS}) as term from benchmark)),
weight as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
           from posting semi join asked using (term), size group by term),
part as (select item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * docs) // words))) as s
         from asked join weight using (term) join posting using (term) join d using (doc_id), size),
scored as (select item_id, doc_id, sum(s)::bigint as score from part group by all having sum(s) > 0)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from scored
qualify rank <= {{k}}
"""


def ranked_search(k: int) -> str:
    return RANKED_SEARCH.format(k=k)


def mix_sources(spec: MixSpec, crawl: str) -> str:
    def weight(level: str) -> str:
        cases = "".join(f" when {level} = '{v}' then {w}" for v, w in spec.weights.get(level, {}).items())
        return f"case{cases} else 1 end" if cases else "1"

    a, b, c = spec.levels
    n = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    parts = [f"""
with d as (select doc_id, case when source = '{crawl}' then 'crawl' else 'curated' end as domain, coalesce(lang, '') as lang,
           coalesce(source, '') as source, {n}::bigint as n_tokens from documents),
leaf as (select {a}, {b}, {c}, sum(n_tokens) as n, sum(n_tokens)::hugeint * {spec.max_epochs} as cap from d group by all),
total as (select sum(n)::hugeint as b from leaf)"""]
    given = "total"
    for i, level in enumerate(spec.levels):
        path, up = ", ".join(spec.levels[: i + 1]), ", ".join(spec.levels[:i])
        join = f"join {given} using ({up})" if i else f"cross join {given}"
        family = f"partition by {up}" if i else ""
        b_col = "given" if i else "b"
        parts.append(f"""
n{i} as (select {path}, sum(cap)::hugeint as cap, {weight(level)} as w, any_value({b_col})::hugeint as b from leaf {join} group by {path}),
r{i} as (select *, coalesce(sum(cap) over (f order by cap::double / w, {level} rows between unbounded preceding and 1 preceding), 0)::hugeint as before,
         sum(w) over (f order by cap::double / w, {level} rows between current row and unbounded following)::hugeint as rest from n{i} window f as ({family})),
s{i} as (select *, cap * rest <= w * (b - before) as sat from r{i}),
u{i} as (select *, min(before) filter (not sat) over (f) as b0, max(rest) filter (not sat) over (f) as w0 from s{i} window f as ({family})),
g{i} as (select {path}, case when sat then cap else (w * (b - b0)) // w0 end as given from u{i})""")
        given = f"g{i}"
    parts.append(f"""
p as (select d.*, given // n as whole, given % n as rest from d join g2 using ({a}, {b}, {c}) join leaf using ({a}, {b}, {c}) where given > 0),
e as (select p.*, unnest(range(1, whole::bigint + 1)) as epoch from p),
k as (select *, whole + 1 as epoch, md5('{spec.seed}:' || (whole + 1)::bigint || ':' || coalesce(doc_id::varchar, 'null')) as k from p where rest > 0),
x as (select *, sum(n_tokens) over (partition by {a}, {b}, {c} order by k, n_tokens rows unbounded preceding) as upto from k)
select doc_id, {a}, {b}, {c}, n_tokens, epoch::integer as epoch from e
union all select doc_id, {a}, {b}, {c}, n_tokens, epoch::integer from x where upto <= rest""")
    return ",".join(parts)


def url_filter(spec: UrlRules, levels: int) -> str:
    """Templates a level at a time, for paths of so many segments at most; then merges place by place; then the purity test."""
    rules = sorted(spec.rules, key=lambda x: -len(x[1]))

    def rule_case(what: int) -> str:
        out = ""
        for r in rules:
            top, slash, rest = r[1].partition("/")
            out += f" when (host = '{top}' or ends_with(host, '.{top}')) and starts_with(path, '{slash + rest}') then '{r[what]}'"
        return f"case{out} end"

    d = levels
    parts = [f"""
with lab as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by 1),
a as (select page_id, strpos(coalesce(url, ''), '://') as s, url from pages),
h as (select page_id, case when s > 0 then substring(url, s + 3) else '' end as rest from a),
hp as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from h),
u as (select hp.*, lab.bad, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from hp
      left join lab on lab.doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') as bigint)),
l0 as (select *, []::varchar[] as tpl, parts as segs, false as ended from u)"""]
    for i in range(d):
        # A path goes on until it has no more segments, or until a node above had fewer URLs than a branch needs.
        parts.append(f"""
c{i} as (select host, tpl, segs[{i + 1}] as seg, count(*) as c, sum(count(*)) over (partition by host, tpl) as n from l{i} where len(segs) > {i} and not ended group by host, tpl, segs[{i + 1}]),
l{i + 1} as (select l.* exclude (tpl, ended), l.ended or coalesce(c.n < {spec.min_urls}, false) as ended,
        case when c.seg is null then l.tpl when c.c >= {spec.min_urls} then list_append(l.tpl, c.seg) else list_append(l.tpl, '#*') end as tpl
        from l{i} l left join c{i} c on not l.ended and c.host = l.host and c.tpl = l.tpl and c.seg = l.segs[{i + 1}])""")
    parts.append(f"""
m0 as (select host, tpl, tpl as t, count(bad) as n, coalesce(sum(bad), 0) as b from l{d} group by all)""")
    for i in range(d):
        parts.append(f"""
o{i} as (select *, case when len(t) > {i} then list_concat(list_append(t[1:{i}], '#*'), t[{i + 2}:]) else t end as open,
        sum(n) over (partition by host, t) as tn, sum(b) over (partition by host, t) as tb from m{i}),
q{i} as (select distinct host, open, t, tn, tb from o{i}),
f{i} as (select host, open, first(tn order by tn desc, t desc) as ln, first(tb order by tn desc, t desc) as lb from q{i} group by all),
a{i} as (select q.*, coalesce(tn = 0 or abs(tb / tn - lb / ln) <= sqrt(ln(2 / {spec.alpha}) / 2) * (1 / sqrt(tn) + 1 / sqrt(ln)), false) as alike from q{i} q join f{i} using (host, open)),
k2{i} as (select host, open, count(*) filter (alike) as k, bool_or(t = open and not alike) as taken from a{i} group by all),
m{i + 1} as (select o.host, o.tpl, case when a.alike and k.k > 1 then (case when k.taken then list_concat(list_append(o.t[1:{i}], '#+'), o.t[{i + 2}:]) else o.open end) else o.t end as t, o.n, o.b
        from o{i} o join a{i} a on a.host = o.host and a.open = o.open and a.t = o.t join k2{i} k on k.host = o.host and k.open = o.open)""")
    parts.append(f"""
g as (select count(bad) as seen, count(bad) - coalesce(sum(bad), 0) as good from u),
v as (select host, tpl, t, (sum(n - b) over w * (case when seen = 0 then 1 else seen end) + {spec.prior} * (case when seen = 0 then 1 else good end))::hugeint * 100
      < ((sum(n) over w + {spec.prior}) * (case when seen = 0 then 1 else seen end))::hugeint * {spec.min_good_percent} as reject
      from m{d}, g window w as (partition by host, t))
select page_id, l.host, l.path, {rule_case(1).replace('host', 'l.host')} as rule,
       coalesce({rule_case(0).replace('host', 'l.host')}, case when reject then 'block' else 'allow' end) as verdict, array_to_string(list_transform(v.t, lambda x: case when x in ('#*', '#+') then x[2] else x end), '/') as template
from l{d} l join v on v.host = l.host and v.tpl = l.tpl""")
    return ",".join(parts)
