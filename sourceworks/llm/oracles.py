"""DuckDB SQL for the queries that it can express over whole tables."""

from __future__ import annotations

from sourceworks.llm.hosts import SUFFIXES

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_FRACTION = "cast('0x' || substr(md5({text}), 1, 8) as bigint) / 4294967296.0"

OP5 = r"""
with urls as (
    select page_id,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
           regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '') as site
    from (select page_id, url from pages)),
judged as (select doc_id, max(coalesce(cast(quality = 0 or toxic = 1 as int), 0)) as bad from labels where doc_id is not null group by doc_id),
counted as (select site, count(bad) as n, coalesce(sum(bad), 0) as k, regexp_matches(site, '^([0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}|\[.*\])$') as address,
                   regexp_extract(site, '(?:^|\.)({suffixes})$', 1) as listed
            from urls left join judged on doc_id = page_id group by site),
tops as (select *, case when address then '' when listed <> '' then listed else string_split(site, '.')[-1] end as suffix from counted),
hosts as (select site, n, k, suffix,
                 if(address or site = suffix, site, string_split(site[1:length(site) - length(suffix) - 1], '.')[-1] || '.' || suffix) as domain
          from tops),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by all),
s1 as (select *, (select (sum(k) + 0.5) / (sum(n) + 1.0) from suffixes) as parent from suffixes),
s2 as (select suffix, (k + parent * s) / (n + s) as rate from s1, ({strength_s1}) t(s)),
d1 as (select d.*, s2.rate as parent from domains d join s2 on s2.suffix = d.suffix),
d2 as (select domain, suffix, (k + parent * s) / (n + s) as rate from d1, ({strength_d1}) t(s)),
h1 as (select h.*, d2.rate as parent from hosts h join d2 on d2.domain = h.domain and d2.suffix = h.suffix),
h2 as (select site, (k + parent * s) / (n + s) as rate, n + s as weight from h1, ({strength_h1}) t(s)),
known as (select site, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) as low from h2)
select page_id, u.host, path,
       case when {fr} then 'org/fr/' when {en} then 'example.net/en/' when {de} then 'example.com/de/' when {net} then 'net/' end as rule,
       case when {en} then 'allow' when {de} then 'block' when {fr} then 'allow' when {net} then 'block'
            when low > 0.5 then 'block' else 'allow' end as verdict
from urls u left join known on known.site = u.site
"""


def _strength(table: str) -> str:
    return f"""select case when coalesce(room, 0) = 0 then 2.0
        else 1 / least(greatest((seen - binomial) / room, 1e-4), 1.0 / 3) - 1 end
        from (select sum(n * power(k / n - parent, 2)) as seen, sum(parent * (1 - parent)) as binomial,
                     sum(parent * (1 - parent) * (n - 1)) as room from {table} where n > 0)"""


def _fits(host: str, path: str) -> str:
    return f"((u.host = '{host}' or ends_with(u.host, '.{host}')) and starts_with(path, '{path}'))"


OP5 = OP5.format(
    **{f"strength_{t}": _strength(t) for t in ("s1", "d1", "h1")},
    suffixes="|".join(s.replace(".", r"\.") for s in SUFFIXES),
    fr=_fits("org", "/fr/"),
    en=_fits("example.net", "/en/"),
    de=_fits("example.com", "/de/"),
    net=_fits("net", "/"),
)

OP8 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, source is null as none,
                  coalesce(text, '') as text, {WORDS.format(text="text")} as w from documents),
windows as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
repeated as (select r, i from windows qualify count(*) over (partition by r, k) > 1),
covered as (select r, sum(step) as n from (
    select r, least(3, coalesce(lead(i) over (partition by r order by i) - i, 3)) as step from repeated) group by r),
lines as (select r, host, none, text, line, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) as normal,
                 len({WORDS.format(text="line")}) as w
          from (select r, host, none, text, unnest(string_split(text, chr(10))) as line from d)),
held as (select host, none, normal, count(distinct text) as n from lines where w > 0 group by all),
common as (select host, none, normal from held where n > 100),
removed as (select r, sum(w) as n from lines l join common c on c.host = l.host and c.none = l.none and c.normal = l.normal
            where w > 0 group by r),
dups as (select r, count(*) - count(distinct line) as n from lines where w > 0 group by r),
counted as (
    select doc_id, len(w) as n_words, coalesce(cast(list_sum(list_transform(w, lambda x: length(x))) as bigint), 0) as word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(u.n, 0) as n_dup_lines,
           coalesce(cast(c.n as bigint), 0) as n_repeat_words, coalesce(x.n, 0) as gone
    from d left join covered c on c.r = d.r left join dups u on u.r = d.r left join removed x on x.r = d.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - gone >= n_words * 0.5 as kept
from counted
"""

OP9 = f"""
with d as (select doc_id, source, len({WORDS.format(text="text")}) as size from documents),
sources as (select source, cast(sum(size) as bigint) as c from d group by source),
weighed as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double
                      else 1.0::double end as w, 2.0::double * c as cap from sources),
steps as (select *, (1.5::double * sum(c) over () - coalesce(sum(cap) over (order by cap / w, source rows between unbounded preceding and 1 preceding), 0))
                    / sum(w) over (order by cap / w, source rows between current row and unbounded following) as unit from weighed),
level as (select coalesce(arg_min(unit, cap / w) filter (where unit * w <= cap), 0) as unit from steps),
targets as (select source, c, least(cap, w * level.unit) as target from weighed, level),
line as (select d.*, c, target, row_number() over (partition by d.source order by size, md5('mix:' || doc_id), doc_id) as rank,
                if(c > 0, target / c, 0) as e, {_FRACTION.format(text="'mix-offset:' || coalesce(d.source, 'null')")} as s
         from d join targets t on t.source is not distinct from d.source)
select doc_id, size, c as source_size, target,
       size * cast(least(floor(rank * e + s) - floor((rank - 1) * e + s), 2) as bigint) as taken
from line
"""

_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
with pieces as (
    select lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') as w
    from (select coalesce(lang, 'und') as lang,
                 unnest(regexp_split_to_array({_LOWER.format(text="coalesce(text, '')")}, '[.,;:!?\n\x0B\x0C\r]')) as piece from documents)),
numbered as (select row_number() over () as p, lang, w from pieces where len(w) > 0),
total as (select lang, cast(sum(len(w)) as bigint) as n from numbered group by lang),
places as (select p, lang, w, unnest(range(1, len(w) + 1)) as i from numbered),
grams as (select lang, k, w[i:i + k - 1] as ws from places, (select unnest(range(1, 5)) as k) where i + k - 1 <= len(w)),
f as (select lang, k, ws, cast(count(*) as bigint) as a from grams group by all having count(*) >= 30),
longest as (
    select lang, ws, max(a) as longer from (
        select lang, ws[1:k - 1] as ws, a from f where k > 2 union all select lang, ws[2:k] as ws, a from f where k > 2) group by all),
candidates as (select f.* from f left join longest x on x.lang = f.lang and x.ws = f.ws where f.k > 1 and (x.longer is null or 100 * x.longer < 80 * f.a)),
cuts as (
    select c.lang, c.ws, c.k, c.a, cut, l.a as l, r.a as r, cast((2000000::hugeint * c.a) // (l.a + r.a) as bigint) as score
    from (select *, unnest(range(1, k)) as cut from candidates) c
    join f l on l.lang = c.lang and l.ws = c.ws[1:c.cut] join f r on r.lang = c.lang and r.ws = c.ws[c.cut + 1:c.k]),
best as (select * from cuts qualify row_number() over (partition by lang, ws order by score, cut) = 1),
ranked as (select *, array_to_string(ws, ' ') as phrase from best),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from ranked)
select p.lang, rank, phrase, a, l, r, n, score from placed p join total t on t.lang = p.lang where rank <= 2000
"""

OP12 = rf"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
split as (select r, doc_id, unnest(range(1, len(parts) + 1)) as i, parts from d),
lines as (select r, doc_id, i, parts[i] as line,
                 {_LOWER.format(text="trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from split),
held as (select key, max(doc_id) as last from lines where length(key) >= 20 group by key having count(distinct r) >= 3),
judged as (select l.r, l.doc_id, i, line, h.key is not null and l.doc_id is distinct from h.last as gone from lines l left join held h on h.key = l.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from judged group by r, doc_id
"""
