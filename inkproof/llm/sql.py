"""DuckDB SQL that gives the same rows as the registered queries of this subpackage.

op2 compares the full shingle sets of every pair that shares a shingle, op6 every pair of vectors, op10
every window with every document: the plain form of what the operators find by their own methods.
op3, op8 (tokenizers) and op9 (a learned model) have none; tests/llm holds them against plain Python.
"""

from __future__ import annotations

from inkproof.llm.chat import CONTROL, END, SAYS, TURN

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hexadecimal: str) -> str:
    """Five hexadecimal digits are four letters."""
    number = f"('0x' || substr({hexadecimal}, 5 * g + 1, 5))::int"
    letters = " || ".join(f"substr('{_BASE32}', 1 + (({number} >> {shift}) & 31), 1)" for shift in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(8), lambda g: {letters}), '')"


def _escaped(text: str) -> str:
    out = f"replace(coalesce({text}, ''), '\\', '\\\\')"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP1 = f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h from p),
f as (select *, min(page_id) over (partition by h) as first from d)
select page_id, payload_bytes::bigint as payload_bytes, {_base32('h')} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from f
"""

_SHINGLES = f"""
w as (select doc_id, list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'),
  lambda x: x <> '') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as shingles
  from w)
"""

OP2 = f"""
with recursive {_SHINGLES},
e as (select doc_id, unnest(shingles) as shingle from s),
n as (select doc_id, len(shingles) as n from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as shared
  from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * shared >= 75 * (x.n + y.n - shared)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from documents
  union select reach.doc_id, ways.b from reach join ways on ways.a = reach.other)
select n.doc_id, n.n::bigint as n_shingles, min(other) as component_id, n.doc_id = min(other) as kept
from n join reach on reach.doc_id = n.doc_id group by 1, 2
"""

OP4 = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, {_escaped('text')})) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, {_escaped('text')}), '')) as loss_sha256,
  sum({len(TURN) + len(SAYS) + len(END)} + length({_escaped('role')}) + length({_escaped('text')}))::bigint as formatted_chars
from t group by conv_id
"""

OP6 = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id
  and list_cosine_similarity(a.e, b.e) >= 0.95),
ways as (select a, b from links union all select b, a from links),
reach as (select vec_id, vec_id as other from embeddings
  union select reach.vec_id, ways.b from reach join ways on ways.a = reach.other),
many as (select a, count(*) as n from ways group by 1)
select r.vec_id, coalesce(any_value(m.n), 0) as n_links, min(r.other) as component_id, r.vec_id = min(r.other) as kept
from reach r left join many m on m.a = r.vec_id group by r.vec_id
"""

OP10 = f"""
with dw as (select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
iw as (select item_id, regexp_extract_all({_lower("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from benchmark where text is not null and item_id is not null),
win as (select distinct item_id, least(10, len(words)) as size,
  array_to_string(words[i:i + least(10, len(words)) - 1], ' ') as w
  from (select item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) as i from iw where len(words) > 0)),
place as (select doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') as w from
  (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i
   from dw cross join (select distinct size from win) where len(words) >= size)),
hit as (select doc_id, i, place.size, item_id from place join win on place.w = win.w and place.size = win.size),
items as (select doc_id, count(distinct item_id) as n_items,
  array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from hit group by 1),
many as (select doc_id, count(distinct word) as n_hit
  from (select doc_id, unnest(range(i, i + size)) as word from hit) group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from dw left join items using (doc_id) left join many using (doc_id)
"""

# the plain form of the interpolated models: each order's counts, contexts and shares, from the shortest up
def _op7(order: int = 5, support: int = 4) -> str:
    """Variable-order models by one table per width of grams, widest first; probabilities narrowest first."""
    tables = [
        f"g{order + 1} as (select substr(t, i, {order + 1}) as g, count(*) filter (learned = 'allow') as a, "
        "count(*) filter (learned = 'block') as r from place group by 1)"
    ]
    tables += [
        f"g{w} as (select substr(g, 2) as g, sum(a)::bigint as a, sum(r)::bigint as r from g{w + 1} group by 1)" for w in range(order, 0, -1)
    ]
    tables.append("letters as (select greatest(count(*), 1) as v from g1)")
    for w in range(1, order + 2):
        tables.append(
            f"c{w} as (select substr(g, 1, {w - 1}) as c, sum(a) as na, sum(r) as nr, count(*) filter (a > 0) as ka, "
            f"count(*) filter (r > 0) as kr from g{w} group by 1)"
        )
        below = ("(1.0::double / v)", "(1.0::double / v)") if w == 1 else ("pa", "pr")
        held = "true" if w == 1 else f"na + nr >= {support}"
        joined = "letters" if w == 1 else f"p{w - 1} p on p.g = substr(n.g, 2)"
        link = "," if w == 1 else "join"
        tables.append(
            f"p{w} as (select n.g, case when {held} and na > 0 then (a + ka * {below[0]}) / (na + ka) else {below[0]} end as pa, "
            f"case when {held} and nr > 0 then (r + kr * {below[1]}) / (nr + kr) else {below[1]} end as pr "
            f"from g{w} n join c{w} c on c.c = substr(n.g, 1, {w - 1}) {link} {joined})"
        )
    return f"""
with u as (
  select page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path,
    repeat(chr(2), {order}) || coalesce(url, '') || chr(3) as t, left(md5(coalesce(url, '')), 1) in ('0', '1', '2') as held
  from pages),
ruled as (
  select *, case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from u),
known as (
  select *, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as decided from ruled),
place as (select t, case when not held then decided end as learned, unnest(range(1, length(t) - {order} + 1)) as i from known),
{", ".join(tables)},
scored as (
  select t, sum(round((ln(pa) - ln(pr)) * 1000000)::bigint)::bigint as total, count(*)::bigint as many
  from (select distinct t, unnest(range(1, length(t) - {order} + 1)) as i from known) x join p{order + 1} p on p.g = substr(t, i, {order + 1}) group by 1),
judged as (select *, (total - total % many) // many as score from scored),
bins as (
  select greatest(-2000, least(2000, floor(score / 1000.0::double)))::bigint as bin,
    count(*) filter (decided = 'allow') as allow, count(*) filter (decided = 'block') as block
  from known join judged using (t) where held and decided is not null group by 1),
edges as (
  select bin, coalesce(sum(allow) over before, 0) as allow, coalesce(sum(block) over before, 0) as block from bins
  window before as (order by bin rows between unbounded preceding and 1 preceding)
  union all select max(bin) + 1, sum(allow), sum(block) from bins having count(*) > 0),
best as (
  select case when min(n.allow) > 0 and min(n.block) > 0 then 1000 * arg_max(bin, [e.block / n.block - e.allow / n.allow, -abs(bin), bin]) else 0 end as least_score
  from edges e, (select sum(allow)::double as allow, sum(block)::double as block from bins) n)
select page_id, host, path, rule, coalesce(decided, case when score >= coalesce(least_score, 0) then 'allow' else 'block' end) as verdict, score
from known join judged using (t), best
"""


OP7 = _op7()

# crc32 by its table of 256 entries; the repair keeps, per row and state, the cheapest way with the ASCII-least letters
OP11 = """
with recursive
bits as (select list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
how as (select raw.*, xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(key, ''), lambda x: ascii(x)::bigint),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as how from raw, bits),
damaged as (select dense_rank() over (order by conv_id) as c, conv_id, turn, case when how = 4 then 'user' else role end as role,
  case when how = 1 then '' when how = 2 then translate(text, '.!?', '') else text end as text, how
  from (select * from how where how <> 0 union all select * from how where how = 3)),
placed as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as tail from damaged),
faulty as (select *, substr(role, 1, 1) as r, lag(substr(role, 1, 1)) over (partition by c order by i) as r0,
  case when tail = '' then 1 when row_number() over (partition by c, role, text order by i) > 1 then 2
    when right(tail, 1) not in ('.', '!', '?') then 3 else 0 end as fault from placed),
moves(p, ins, mid, added) as (values (0, 0, 0, ''), (0, 1, 2, 'user:\n'), (0, 2, 3, 'user:\nassistant:\n'), (1, 0, 1, ''), (1, 1, 2, 'user:\n'),
  (1, 2, 3, 'user:\nassistant:\n'), (2, 0, 2, ''), (2, 1, 3, 'assistant:\n'), (2, 2, 2, 'assistant:\nuser:\n'), (3, 0, 3, ''),
  (3, 1, 2, 'user:\n'), (3, 2, 3, 'user:\nassistant:\n')),
keeps(mid, r, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits as (
  select p, 'D' as edit, '' as r, p as q, 2 as price, 'D' as letters, '' as added, '' as becomes from moves where ins = 0
  union all select p, 'K', r, q, 5 * ins, repeat('I', ins) || 'K', added, '' from moves join keeps using (mid)
  union all select p, 'R', '', case when mid = 2 then 3 else 2 end, 5 * ins + 1, repeat('I', ins) || 'R', added,
    case when mid = 2 then 'assistant' else 'user' end from moves),
ways as (
  select distinct c, 0::bigint as i, 0 as q, 0::bigint as cost, '' as audit, '' as lines from damaged
  union all
  select c, i, q, best.cost, best.audit, best.lines from (
    select w.c, f.i, e.q, arg_min({'cost': w.cost + e.price + case when e.edit <> 'D' and f.fault = 3 then 5 else 0 end,
        'audit': w.audit || e.letters,
        'lines': w.lines || e.added || case e.edit when 'D' then '' when 'K' then f.role || ':' || f.text || chr(10) else e.becomes || ':' || f.text || chr(10) end},
      {'cost': w.cost + e.price + case when e.edit <> 'D' and f.fault = 3 then 5 else 0 end, 'audit': w.audit || e.letters}) as best
    from ways w join faulty f on f.c = w.c and f.i = w.i + 1
      join edits e on e.p = w.q and (e.edit = 'D' or f.fault in (0, 3)) and (e.edit <> 'K' or e.r = f.r)
    group by 1, 2, 3)),
tails(q, price, letters, added) as (values (0, 0, '', ''), (1, 10, 'II', 'user:\nassistant:\n'), (2, 5, 'I', 'assistant:\n'), (3, 0, '', '')),
final as (select w.c, arg_min({'cost': w.cost + t.price, 'audit': w.audit || t.letters, 'lines': w.lines || t.added},
    {'cost': w.cost + t.price, 'audit': w.audit || t.letters}) as best
  from ways w join tails t using (q) join (select c, max(i) as i from faulty group by 1) n on n.c = w.c and n.i = w.i group by 1),
counts as (select c, any_value(conv_id) as conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
  count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
  count(*) filter (i > 1 and r0 || r not in ('su', 'ua', 'au')) as illegal from faulty group by 1)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
  sha256(coalesce(left(best.lines, -1), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
  left join (counts join final using (c)) f on f.conv_id is not distinct from o.conv_id
"""

_TERMS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
with d as (select row_number() over () as k, doc_id, {_TERMS.format(_lower("coalesce(text, '')"))} as words from documents),
s as (select count(*) filter (len(words) > 0)::bigint as docs, greatest(coalesce(sum(len(words)), 0), 1)::bigint as total from d),
e as (select k, doc_id, len(words)::bigint as n, unnest(words) as term from d),
tf as (select k, doc_id, n, term, count(*)::bigint as tf from e group by all),
weights as (select term, floor(1000 * ln((2 * min(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, s group by 1),
q as (select item_id, unnest({_TERMS.format(_lower("coalesce(text, '')"))}) as term
  from (select distinct item_id, text from benchmark where item_id is not null)),
times as (select item_id, term, count(*)::bigint as times from q group by all),
scores as (
  select item_id, k, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint as score
  from times join weights using (term) join tf using (term), s group by 1, 2, 3),
places as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id asc nulls last) as rank, doc_id, score
  from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from places where rank <= 20
"""

SQL: dict[str, str] = {
    "op1_warc": OP1,
    "op2_minhash": OP2,
    "op4_chat": OP4,
    "op6_multi_index": OP6,
    "op7_url_filter": OP7,
    "op10_decontaminate": OP10,
    "op11_conversation_repair": OP11,
    "op12_ranked_search": OP12,
}
