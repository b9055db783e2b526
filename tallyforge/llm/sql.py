"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import LEAST, LICENCE_FILE, PARAGRAPH, TERM, vocabulary
from .mixing import SEED, offset_of
from .quality import METRICS, MIN_GROUP, SKETCH_BITS, SPREAD

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NO_WS = r"regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g')"


def _top_bits(x: str, bits: int) -> str:
    shift = f"greatest(length(bin({x})) - {bits}, 0)::int"
    return f"((({x}) >> {shift}) << {shift})"


def _width(x: str, bits: int) -> str:
    return f"(1::bigint << greatest(length(bin({x})) - {bits}, 0)::int)"


def _op1() -> str:
    value = {m: f"({top} * {scale}) // greatest({below}, 1)" for m, (top, scale, below, _) in METRICS.items()}
    rows = " union all ".join(f"select lang, source, '{m}' as metric, {_top_bits(v, SKETCH_BITS)} as bucket from m where not base_failed" for m, v in value.items())
    percent = "case metric " + " ".join(f"when '{m}' then {v[3]}" for m, v in METRICS.items()) + " end"
    bound = lambda m, k: f"coalesce(a.mx['{m}'][{k}], b.mx['{m}'][{k}], c.mx['{m}'][{k}])"
    outside = " or ".join(f"coalesce({_top_bits(value[m], SKETCH_BITS)} > {bound(m, 2)} or {_top_bits(value[m], SKETCH_BITS)} < {bound(m, 1)}, false)" for m in METRICS)
    return rf"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as w from documents),
t as (select r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as p from d)),
again as (select r, p from (select r, p, count(*) over (partition by r, g) as n from t) where n > 1),
cover as (select r, count(distinct p + o) as n from again, (select unnest([0, 1, 2]) as o) group by r),
m0 as (
  select d.r, doc_id, lang, source, len(w)::bigint as n_words, length({_NO_WS.format('text')})::bigint as word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
    (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::bigint as n_upper,
    (len(list_filter(string_split(text, chr(10)), lambda x: length({_NO_WS.format('x')}) > 0)) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length({_NO_WS.format('x')}) > 0))))::bigint as n_dup_lines,
    coalesce(cover.n, 0)::bigint as n_repeat_words
  from d left join cover on d.r = cover.r),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m0),
fine as (select lang, source, metric, bucket, count(*) as n from ({rows}) group by all),
sketch as (
  select 0 as level, lang as l, source as s, metric, bucket, n from fine
  union all select 1, lang, null, metric, bucket, sum(n) from fine group by lang, metric, bucket
  union all select 2, null, null, metric, bucket, sum(n) from fine group by metric, bucket),
upto as (select *, sum(n) over (partition by level, l, s, metric order by bucket) as u, sum(n) over (partition by level, l, s, metric) as total from sketch),
cuts as (select *, {percent} as percent from upto),
q as (select level, l, s, metric, min(bucket) filter (100 * u >= (100 - percent) * total) as low, min(bucket) filter (100 * u >= 50 * total) as mid, min(bucket) filter (100 * u >= percent * total) as high, max(total) as total from cuts group by all),
dev as (select metric, (sum(n * abs(bucket - mid)) // sum(n))::bigint as off from sketch join q using (metric) where sketch.level = 2 and q.level = 2 group by metric),
lim as (select level, l, s, map(list(metric), list([low - {SPREAD} * (mid - low) - off - {_width('low', SKETCH_BITS)}, high + {SPREAD} * (high - mid) + off + {_width('high', SKETCH_BITS)}])) as mx from q join dev using (metric) where level = 2 or total >= {MIN_GROUP} group by level, l, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({outside}) as kept
from m left join lim a on a.level = 0 and a.l is not distinct from m.lang and a.s is not distinct from m.source
left join lim b on b.level = 1 and b.l is not distinct from m.lang left join lim c on c.level = 2
"""


def _decoded(x: str) -> str:
    """Unreserved characters as they are, other escapes in capitals."""
    escaped = "case when regexp_matches(x, '^[0-9A-Fa-f]{2}') then case when regexp_matches(chr(('0x' || left(x, 2))::int), '^[A-Za-z0-9._~-]$') then chr(('0x' || left(x, 2))::int) else '%' || upper(left(x, 2)) end || substr(x, 3) else '%' || x end"
    return f"(split_part({x}, '%', 1) || array_to_string(list_transform(string_split({x}, '%')[2:], lambda x: {escaped}), ''))"


def _op3() -> str:
    from .queries import LISTED, RULES
    from .urls import TRACKING

    values = lambda rows: ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rows)
    fits = "(p.host = e.host or ends_with(p.host, '.' || e.host)) and starts_with(p.path, e.path)"
    return rf"""
with u as (select row_number() over () as r, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
rules(host, path, verdict) as (values {values(RULES)}), listed(host, path, verdict) as (values {values(LISTED)}),
a as (select r, arg_max(e.host || e.path, length(e.host || e.path)) as rule, arg_max(e.verdict, length(e.host || e.path)) as verdict from p, rules e where {fits} group by r),
b as (select r, max(e.verdict) as verdict from p, listed e where {fits} group by r),
c0 as (select r, md5(url) as h, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '\.$', '') as host, path, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{TRACKING}'))) as asked
  from p join (select row_number() over () as r, url from pages) using (r) where host <> ''),
c as (select r, h, host || regexp_replace({_decoded('path')}, '/+$', '') || case when len(asked) > 0 then '?' || {_decoded("array_to_string(asked, '&')")} else '' end as canon from c0),
w as (select distinct canon from c where ends_with(h, '0'))
select page_id, p.host, p.path, a.rule, coalesce(a.verdict, b.verdict, case when w.canon is not null then 'block' end, 'allow') as verdict from p left join a using (r) left join b using (r) left join c using (r) left join w using (canon)
"""


def _op5() -> str:
    size = f"len({_WORDS})::bigint"
    return f"""
with d as (select doc_id, source, {size} as size from documents),
k as (select *, {_top_bits('size', 3)} as cl, md5(coalesce(doc_id::varchar, '')) as h from d),
s as (select coalesce(source, '') as key, source is null as nul, sum(size)::bigint as source_size from d group by all),
w as (select *, ([3.0, 1.0, 2.0]::double[])[((row_number() over (order by nul, key) - 1) % 3 + 1)::int] as w, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as total from s),
o as (select *, sum(w) over () as all_w, coalesce(sum(cap) over b, 0) as bc, coalesce(sum(w) over b, 0) as bw from w window b as (order by cap / w, nul, key rows between unbounded preceding and 1 preceding)),
c as (select *, (total - bc) / (all_w - bw) > cap / w as capped from o),
l as (select *, (total - sum(case when capped then cap else 0 end) over ()) / (all_w - sum(case when capped then w else 0 end) over ()) as level from c),
t as (select key, nul, source_size, case when capped then cap else coalesce(level * w, 0) end as target from l),
r as (select k.*, t.source_size, t.target, row_number() over (partition by t.key, t.nul order by cl, h, size) as rank, coalesce(t.target / nullif(t.source_size, 0), 0) as rate from k join t on coalesce(k.source, '') = t.key and (k.source is null) = t.nul)
select doc_id, size, source_size, target, ((floor(rank::double * rate + {offset_of(SEED)!r}::double) - floor((rank - 1)::double * rate + {offset_of(SEED)!r}::double))::bigint * size)::bigint as taken from r
"""


def _op2() -> str:
    tv = ", ".join(f"('{tpl}', '{name}', '{t}', {c})" for tpl, name, t, c in vocabulary())
    idf = "floor(1000 * ln(1.0 + n.n / coalesce(df.df, 1)::double))::bigint"
    return rf"""
with tv(tpl, license, t, c) as (values {tv}),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text,
  '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || case when doc_id % 64 = 0 then (doc_id // 64) || '/LICENSE'
    when doc_id % 8 = 0 then (doc_id // 64) || '/' || (doc_id // 8) || '/LICENSE' else (doc_id // 64) || '/' || (doc_id // 8) || '/' || doc_id || '.txt' end as path from documents),
n as (select count(*) as n from d),
df as (select t, count(*) as df from (select distinct r, unnest(regexp_extract_all(lower(text), '{TERM}')) as t from d) group by t),
tw as (select tpl, license, tv.t, c * {idf} as w from tv left join df using (t), n), ts as (select tpl, license, sum(w * w)::double as size from tw group by tpl, license),
ps as (select r, unnest(string_split(text, chr(10))) as p from d union select r, unnest(regexp_split_to_array(text, '{PARAGRAPH}')) from d union select r, text from d where regexp_matches(path, '{LICENCE_FILE}')),
pd as (select p, row_number() over () as k from (select distinct p from ps)),
pt as (select k, t, count(*) as c from (select k, unnest(regexp_extract_all(lower(p), '{TERM}')) as t from pd) group by all),
pw as (select k, pt.t, c * {idf} as w from pt join df using (t), n),
nm as (select k, sum((w * w)::double) as norm from pw group by k),
sc as (select k, license, floor(1000.0 * sum(pw.w * tw.w)::bigint / sqrt(max(norm) * max(size)))::bigint as score from pw join tw using (t) join ts using (tpl, license) join nm using (k) group by k, tpl, license),
bp as (select p, max({{'score': score, 'license': license}}) as f from sc join pd using (k) where score >= {LEAST} group by p),
best as (select r, max(f) as f from ps join bp using (p) group by r),
f as (select d.r, doc_id, path, regexp_replace(path, '/[^/]*$', '') as dir, b.f from d left join best b using (r)),
nam as (select dir as place, max(f) as g from f where f is not null and regexp_matches(path, '{LICENCE_FILE}') group by dir),
near as (select f.r, arg_max(struct_pack(p := place, g := g), length(place)) as x from f join nam on f.dir = nam.place or starts_with(f.dir, nam.place || '/') where f.f is null group by f.r)
select doc_id, path, coalesce(f.f.license, x.g.license) as license, coalesce(f.f.score, x.g.score) as score, case when f.f is not null then 'own' else x.p end as license_from from f left join near using (r)
"""


def _op11(k: int = 8, rounds: int = 10) -> str:
    steps = "".join(
        f""",
a{r} as materialized (select vec_id, r, arg_min(c, d * {k} + c) as c, min(d) as d from (select v.vec_id, v.r, m.c, sum((v.x - m.x) * (v.x - m.x))::bigint as d from v join m{r} m using (i) group by all) group by all),
s{r} as (select a.c, v.i, sum(v.x) as s, count(*) as n from a{r} a join v using (r) group by all),
m{r + 1} as materialized (select m.c, m.i, coalesce(((s.s - ((s.s % s.n) + s.n) % s.n) // s.n)::bigint, m.x) as x from m{r} m left join s{r} s using (c, i))"""
        for r in range(rounds + 1)
    )
    return f"""
with e as (select row_number() over () as r, vec_id, embedding as x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda c: coalesce(isfinite(c), false))) = 64),
v as materialized (select r, vec_id, i, floor(x[i]::double * 1024)::bigint as x from e, (select unnest(range(1, 65)) as i)),
f as (select r, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from e qualify c < {k}),
m0 as materialized (select f.c, v.i, v.x from f join v using (r)){steps},
per as (select c, sum(d)::bigint as cluster_inertia from a{rounds} group by c), sha as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from m{rounds} group by c)
select vec_id, c::int as cluster, d as distance, cluster_inertia, (select sum(cluster_inertia) from per)::bigint as inertia, centroid_sha256 from a{rounds} join per using (c) join sha using (c)
"""


def oracle() -> dict[str, str]:
    return {"op1_quality_rules": _op1(), "op2_license_scan": _op2(), "op3_url_filter": _op3(), "op5_source_mixing": _op5(), "op11_ball_clusters": _op11()}
