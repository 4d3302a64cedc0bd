"""DuckDB SQL with the results of those queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SPLIT = r"'[\x20\x09-\x0D]+'"

#: A word and the seven after it, null near the end.
_LEADS = "x || ' ' || " + " || ' ' || ".join(f"lead(x, {k}) over o" for k in range(1, 8))

WARC = f"""with p as (select page_id, coalesce(html, '') h from pages), f as (select h, min(page_id) first_id from p group by h),
d as (select p.page_id, strlen(p.h) payload_bytes, unhex(sha1(p.h))::bit::varchar bits, f.first_id from p join f using (h))
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 (16 * substr(bits, i * 5 + 1, 1)::int + 8 * substr(bits, i * 5 + 2, 1)::int + 4 * substr(bits, i * 5 + 3, 1)::int + 2 * substr(bits, i * 5 + 4, 1)::int + substr(bits, i * 5 + 5, 1)::int + 1)::int, 1)), '') payload_digest,
case when page_id = first_id then 'response' else 'revisit' end record_type, case when page_id <> first_id then first_id end refers_to from d"""

LINE_DEDUP = f"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents), l as (select doc_id, unnest(ls) line, unnest(range(len(ls))) pos from d),
k as (select *, translate(trim(line, {_WS}), '{_UPPER}', '{_LOWER}') as key from l), f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, f.key is not null gone from k left join f on k.key = f.key)
select doc_id, count(*) n_lines, count_if(gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256 from m group by doc_id"""

NGRAM_JOIN = f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_SPLIT}), lambda x: x <> '') w from documents),
i as (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) p0 from w where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[p0 : p0 + 3], ' ') t from i), n as (select doc_id, count(*) n from s group by all),
h as (select hash(string_agg(t, chr(10) order by t)) h, doc_id from s group by doc_id), c as (select doc_id, min(doc_id) over (partition by h) rep from h),
r as (select s.* from s join c using (doc_id) where c.rep = c.doc_id),
j as (select a.doc_id a, b.doc_id b, count(*) k from r a join r b on a.t = b.t and a.doc_id < b.doc_id group by all),
e as (select a, b from j join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
u as (select a, b from e union all select b, a from e), g as (select rep node, rep root from c union select g.node, u.b from g join u on u.a = g.root),
m as (select node, min(root) root from g group by all)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.root, d.doc_id) component_id from documents d left join n using (doc_id) left join c using (doc_id) left join m on m.node = c.rep"""

QUALITY_RULES = f"""with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, {_SPLIT}), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from d),
u as (select doc_id, unnest(w) x, unnest(range(len(w))) p0 from w), i as (select doc_id, p0, {_LEADS} x from u window o as (partition by doc_id order by p0)), g as (select doc_id, p0, count(*) over (partition by doc_id, x) k from i where x is not null),
q as (select doc_id, least(8, coalesce(lead(p0) over (partition by doc_id order by p0) - p0, 8)) c from g where k > 1), p as (select doc_id, sum(c)::bigint n from q group by all),
b as (select doc_id, t, w, l, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
 (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(p.n, 0) n_repeat_words from w left join p using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or 10 * n_symbols > n_words
 or 2 * length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) > length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) or 5 * length(regexp_replace(t, '[^!]', '', 'g')) > n_words
 or 5 * (len(array_to_string(l, '')) - len(array_to_string(list_distinct(l), ''))) > len(array_to_string(l, '')) or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) < 6 * n_words
 or 10 * len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) > 3 * len(l) or 10 * len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•●]\\s'))) > 9 * len(l)) kept from f"""



def _crc32(x: str) -> str:
    """CRC-32 of an ASCII string: each byte is XORed in, then eight steps of the register follow (written as the element -1)."""
    steps = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: list_prepend(ascii(({x})[i])::bigint, list_transform(range(8), lambda k: -1::bigint))))"
    step = "case when e >= 0 then xor(c, e) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {steps}), lambda c, e: {step}))"


PERIODIC = f"""with d as (select doc_id, {_crc32("doc_id::varchar")} h, list_filter(string_split_regex(coalesce(text, ''), {_SPLIT}), lambda x: x <> '') w from documents),
g as (select doc_id, w, len(w) n, h, h // 10 g from d), a as (select *, case when n > 0 then g % n end a from g), p as (select *, 1 + (n - a) // (3 + g % 8) p from a),
m as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) else w end w from p),
u as (select doc_id, n, unnest(w) x, unnest(range(n)) i from m),
j as (select a.doc_id, a.i, b.i - a.i q from u a join u b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i where 4 * (b.i - a.i) <= a.n),
k as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) isle from j),
r as (select doc_id, min(i) s, count(*) + q len, q from k group by doc_id, q, isle having count(*) + q >= greatest(6, 4 * q)),
f as (select doc_id, s, len, min(q) q from r group by doc_id, s, len), z as (select doc_id, count(*) n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) txt from f group by doc_id),
b as (select doc_id, s, len, q from f qualify row_number() over (partition by doc_id order by len desc, s, q) = 1), l as (select doc_id, list((s + q, s + len)) gone from f group by doc_id),
t as (select doc_id, string_agg(x, ' ' order by i) txt from u left join l using (doc_id) where gone is null or len(list_filter(gone, lambda v: i >= v[1] and i < v[2])) = 0 group by doc_id)
select d.doc_id, coalesce(z.n_runs, 0) n_runs, b.s as start, b.len as length, b.q as period, 1000 * b.len // b.q exponent_milli, sha256(coalesce(z.txt, '')) runs_sha256, sha256(coalesce(t.txt, '')) collapsed_sha256
from d left join z using (doc_id) left join b using (doc_id) left join t using (doc_id)"""

_KEY = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
CONVERSATIONS = f"""with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') t, {_crc32(_KEY)} % 20 k from conversations),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(t, '[.!?]', '', 'g') else t end t, unnest(range(case when k = 3 then 2 else 1 end)) from c where k <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, t) i from d),
f as (select *, row_number() over (partition by conv_id, role, t order by i) seen, not regexp_matches(t, '[^\\x20\\x09-\\x0D]') blank, regexp_matches(t, '[.!?][\\x20\\x09-\\x0D]*$') whole, left(role, 1) ini, lag(left(role, 1)) over (partition by conv_id order by i) prior from o),
g as (select conv_id, i, turn, role, t, ini, blank, not blank and seen > 1 duplicate, not blank and seen = 1 and not whole truncated, i > 1 and prior || ini not in ('su', 'ua', 'au') illegal from f),
ins(a, b, letters, txt) as (values ('', '', '', ''), ('', 'u', 'I', '~user:'), ('', 'a', 'II', '~user:~assistant:'), ('s', 's', '', ''), ('s', 'u', 'I', '~user:'), ('s', 'a', 'II', '~user:~assistant:'),
 ('u', 'u', '', ''), ('u', 'a', 'I', '~assistant:'), ('a', 'a', '', ''), ('a', 'u', 'I', '~user:')),
e as (select a, b, letters, replace(txt, '~', chr(10)) txt, 3 * length(letters) cost from ins),
walk(conv_id, i, s, m) as (select distinct conv_id, 0::bigint, '', {{'cost': 0, 'audit': '', 'txt': ''}} from g union all
 select conv_id, i, x.s, min(x.m) from (select g.conv_id, g.i, unnest(case when blank or duplicate then [{{'s': e.b, 'm': {{'cost': m.cost + e.cost + 4, 'audit': m.audit || letters || 'D', 'txt': m.txt || e.txt}}}}]
  else [{{'s': e.b, 'm': {{'cost': m.cost + e.cost + 4, 'audit': m.audit || letters || 'D', 'txt': m.txt || e.txt}}}},
   {{'s': case when e.b = 'u' then 'a' else 'u' end, 'm': {{'cost': m.cost + e.cost + 3 + 3 * truncated::int, 'audit': m.audit || letters || 'R', 'txt': m.txt || e.txt || chr(10) || case when e.b = 'u' then 'assistant:' else 'user:' end || t}}}},
   {{'s': case when e.b || ini in ('s', 'u', 'su', 'ua', 'au') then ini end, 'm': {{'cost': m.cost + e.cost + 3 * truncated::int, 'audit': m.audit || letters || 'K', 'txt': m.txt || e.txt || chr(10) || role || ':' || t}}}}] end) x
  from walk w join e on e.a = w.s join g on g.conv_id is not distinct from w.conv_id and g.i = w.i + 1) where x.s is not null group by all),
n as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count_if(blank) blank, count_if(duplicate) duplicate, count_if(truncated) truncated, count_if(illegal) illegal from g group by conv_id),
z as (select n.conv_id, min({{'cost': m.cost + e.cost, 'audit': m.audit || letters, 'txt': substr(m.txt || e.txt, 2)}}) m from walk w join n on n.conv_id is not distinct from w.conv_id and w.i = n.n
 join e on e.a = w.s and (e.b = 'a' or w.s = '' and e.b = '') group by n.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
 coalesce(m.cost, 0)::bigint as cost, coalesce(m.audit, '') audit, sha256(coalesce(m.txt, '')) repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id left join z on z.conv_id is not distinct from c.conv_id"""

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": "[A-Za-z0-9_-]{20,}",
}
_TERM = r"[\p{L}\p{M}]{3,}"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when i % 2 = 1 then {_DIGITS}[-i]::int else 2 * {_DIGITS}[-i]::int - case when {_DIGITS}[-i]::int > 4 then 9 else 0 end end)) % 10 = 0"
_GOOD = f"""case kind when 'ip' then len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or ltrim(x, '0') <> '' and try_cast(right(x, 3) as int) > 255)) = 0
 when 'card' then length({_DIGITS}) between 14 and 19 and {_LUHN} when 'phone' then length({_DIGITS}) between 10 and 15
 when 'secret' then len(regexp_extract_all(regexp_replace(regexp_replace(m, '[A-Za-z]', 'a', 'g'), '[0-9]+', '0', 'g'), 'a0')) + len(regexp_extract_all(regexp_replace(m, '[A-Za-z]+', 'a', 'g'), '[0-9]a')) >= 5 else true end"""
_FOUND = " union all ".join(f"select r, '{k}' kind, {n} rk, regexp_extract_all(t, '{p}') ms, string_split_regex(t, '{p}') gs from d" for n, (k, p) in enumerate(_PII.items()))
PII = f"""with d as (select doc_id, coalesce(text, '') t, row_number() over () r from documents), a as ({_FOUND}),
x as (select r, kind, rk, unnest(ms) m, unnest(gs[:len(ms)]) g, unnest(gs[2:len(ms) + 1]) h, unnest(range(len(ms))) k from a),
s as (select *, (sum(length(g) + length(m)) over (partition by r, kind order by k) - length(m))::bigint s from x),
b as (select r, kind, rk, s, s + length(m) e, kind || ':' || case when kind in ('card', 'phone') then {_DIGITS} else m end v, list_transform(list_concat(regexp_extract_all(right(g, 60), '{_TERM}')[(case when length(g) > 60 then 2 else 1 end):],
 regexp_extract_all(left(h, 60), '{_TERM}')[:(case when length(h) > 60 then len(regexp_extract_all(left(h, 60), '{_TERM}')) - 1 else 99 end)]), lambda y: lower(y)) near from s where {_GOOD}),
ne as (select v, count(distinct r) n_e from b group by v), et as (select v, t, count(distinct r) n_et from (select r, v, unnest(near) t from b) group by v, t having count(distinct r) >= 3),
nt as (select t, count(distinct r) n_t from (select r, unnest(list_transform(regexp_extract_all(t, '{_TERM}'), lambda y: lower(y))) t from d) where t in (select t from et) group by t),
f as (select v, t from et join ne using (v) join nt using (t), (select count(*)::double n from d) where log2(n * n_et / (n_e * (n_t + 1))) >= log2(n / n_e) / 1.1),
w as (select distinct b.r, f.t from b join f using (v)), y as (select r, regexp_extract_all(t, '{_TERM}') ms, string_split_regex(t, '{_TERM}') gs from d where r in (select r from w)),
u as (select r, unnest(ms) m, unnest(gs[:len(ms)]) g, unnest(range(len(ms))) k from y), z as (select r, m, (sum(length(g) + length(m)) over (partition by r order by k) - length(m))::bigint s from u),
q as (select r, 'term' kind, 5 rk, s, s + length(m) e from z where exists (from w where w.r = z.r and w.t = lower(m)) and not exists (from b where b.r = z.r and b.s < z.s + length(m) and z.s < b.e)),
every as (select r, kind, rk, s, e from b union all from q)
select d.doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip, count(*) filter (kind = 'card') n_card, count(*) filter (kind = 'phone') n_phone,
 sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rk) filter (rk < 4), '')) base_sha256, coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rk), '') spans
from d left join every using (r) group by d.r, d.doc_id"""

ORACLE_SQL = {"op1_warc": WARC, "op7_line_dedup": LINE_DEDUP, "op8_ngram_join": NGRAM_JOIN, "op9_quality_rules": QUALITY_RULES, "op11_periodic": PERIODIC, "op12_pii": PII, "op13_conversations": CONVERSATIONS}
