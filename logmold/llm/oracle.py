"""DuckDB SQL for the queries of :mod:`logmold.llm.queries` that SQL can express.

The others (models, alignments, merges, positions of matches) are tested
against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents),
cut as (
  select doc_id, pos, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '{WORD}') as words
  from lines),
leaves as (
  select doc_id, pos, words, len(words) as n, len(words) || ' ' || array_to_string(words[1:3], ' ') as leaf
  from cut where len(words) >= 3),
often as (select * from leaves qualify count(*) over (partition by leaf) >= 3),
places as (
  select doc_id, pos, leaf, unnest(words[4:]) as word, unnest(range(3, n)) as place from often where n > 3),
supported as (
  select *, count(*) over (partition by leaf, place, word) as support, count(*) over (partition by leaf, place) as size from places),
constants as (
  select doc_id, pos, count(*) as c, string_agg(place || ':' || word, ' ' order by place) as fixed
  from supported where support >= 3 and 100 * support >= size group by doc_id, pos),
templates as (
  select o.doc_id, o.pos,
         case when 100 * (3 + coalesce(c, 0)) >= 60 * n then 't ' || leaf || ' | ' || coalesce(fixed, '')
              else 'w ' || array_to_string(words, ' ') end as template
  from often o left join constants using (doc_id, pos)),
recurring as (
  select template, min(doc_id) as first_doc from templates group by template having count(distinct doc_id) >= 3),
gone as (select doc_id, pos from templates join recurring using (template) where doc_id <> first_doc),
kept as (
  select doc_id, string_agg(line, chr(10) order by pos) as text
  from lines where (doc_id, pos) not in (select doc_id, pos from gone) group by doc_id),
dropped as (
  select doc_id, cast(count(*) as int) as n_dropped, string_agg(pos, ',' order by pos) as dropped from gone group by doc_id)
select d.doc_id, coalesce(n_dropped, 0) as n_dropped, coalesce(dropped, '') as dropped,
       case when n_dropped is null then d.text else coalesce(k.text, '') end as text
from documents d left join dropped using (doc_id) left join kept k using (doc_id)
"""

OP3 = f"""
with rests as (
  select page_id, case when coalesce(position('://' in url), 0) = 0 then '' else substr(url, position('://' in url) + 3) end as rest
  from pages),
urls as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from rests),
rules(rule_host, rule_path, rule_verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host) + length(rule_path)) as rule,
         arg_max(rule_verdict, length(rule_host) + length(rule_path)) as verdict
  from urls join rules on (host = rule_host or suffix(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from urls left join fits using (page_id)
"""

OP4 = f"""
with recursive cut as (
  select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from cut where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as m
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * m >= 85 * (p.n + q.n - m)),
both_ways as (select x, y from links union select y, x from links),
reached as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, b.y from reached r join both_ways b on b.x = r.other),
groups as (select doc_id, min(other) as component_id from reached group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join groups using (doc_id)
"""

OP11 = rf"""
with found as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
sizes as (select r, doc_id, len(t)::bigint as n from found where len(t) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as words from sizes),
counts as (select r, term, count(*)::bigint as tf from (select r, unnest(t) as term from found) group by r, term),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w
            from (select term, count(*)::bigint as df from counts group by term), total),
wanted as (
  select item_id, term, count(*)::bigint as times from (
    select item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select distinct item_id, text from benchmark)) group by item_id, term),
scores as (
  select item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))))::bigint as score
  from wanted join weights using (term) join counts using (term) join sizes using (r), total group by item_id, doc_id, r)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::integer as rank, doc_id, score
from scores where score > 0 qualify rank <= 20
"""

#: crc32 of the id's digits, byte by byte: SQL has no such function.
OP12 = """
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
           lambda x, y: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as step),
ids as (select distinct conv_id::bigint as conv_id from conversations where conv_id is not null),
heads as (
  select conv_id, (xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
           lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) % 9)::bigint as h
  from ids, crc),
own as (
  select conv_id, list(md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) order by turn nulls first) as ids,
         list(strlen(coalesce(text, ''))::bigint order by turn nulls first) as sizes
  from conversations where conv_id is not null group by conv_id),
rebuilt as (
  select o.conv_id, list_concat(case when h = 0 or s.ids is null then [] else s.ids[1:h] end, o.ids[h + 1:]) as ids,
         list_concat(case when h = 0 or s.ids is null then [] else s.sizes[1:h] end, o.sizes[h + 1:]) as sizes
  from own o join heads using (conv_id) left join own s on s.conv_id = o.conv_id - o.conv_id % 5),
spread as (select conv_id, ids, sizes, len(ids) as size, unnest(range(len(ids) + 1)) as depth from rebuilt),
named as (
  select conv_id, size, depth, '/' || array_to_string(case when depth = 0 then [] else ids[1:depth] end, '/') as name,
         case when depth = 0 then null when depth = 1 then '/' else '/' || array_to_string(ids[1:depth - 1], '/') end as up,
         case when depth = 0 then 0 else sizes[depth] end as last
  from spread),
nodes as (
  select name, depth, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(last) as last,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = size), '') as ends
  from named group by name, depth),
children as (select up as name, count(*) as n_children from nodes where up is not null group by up),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (name)),
under as (
  select a.name, sum((b.n_children = 0)::bigint) as n_leaves, sum((b.n_convs - 1) * b.last) as saved
  from full_nodes a join full_nodes b on b.depth >= a.depth and (b.name = a.name or a.depth = 0 or starts_with(b.name, a.name || '/')) group by a.name)
select f.conv_id, f.depth::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, u.n_leaves::bigint as n_leaves,
       u.saved::bigint as saved_tokens, sha256(f.ends) as ends_sha256
from full_nodes f join under u on u.name = f.name left join full_nodes p on p.name = f.up
"""


def _op13() -> str:
    from logmold.llm import license_index as L

    first = ", ".join(f"case when contains(joined, ' {p} ') then len(string_split(split_part(joined, ' {p} ', 1), ' ')) - 1 end" for p, _ in L.BASE)
    last = ", ".join(f"case when contains(joined, ' {p} ') then n_words - {len(p.split())} - (len(string_split(list_last(string_split(joined2, ' {p.replace(' ', '  ')} ')), '  ')) - 1) end"
                     for p, _ in L.BASE)
    count = " + ".join(f"(len(string_split(joined2, ' {p.replace(' ', '  ')} ')) - 1)" for p, _ in L.BASE)
    base = ", ".join(f"case when contains(joined, ' {p} ') then '{label}' end" for p, label in L.BASE)
    having = ", ".join(f"case when contains(joined, ' {k} ') then {i} end" for i, (_, _, k) in enumerate(L.TEMPLATES))
    table = ", ".join(f"({t}, '{w}', {k})" for t, w, k in L.postings())
    names = ", ".join(f"({i}, '{label}', {sum(t == i for t, _, _ in L.postings())})" for i, (label, _, _) in enumerate(L.TEMPLATES))
    return rf"""
with postings(template, word, k) as (values {table}),
names(template, label, size) as (values {names}),
files as (
  select doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') || ' ' as joined
  from documents),
sized as (select *, case when joined = '  ' then 0 else len(string_split(joined, ' ')) - 2 end as n_words,
                 replace(joined, ' ', '  ') as joined2, string_split(trim(joined, ' '), ' ') as words from files),
facts as (
  select doc_id, n_words::bigint as n_words, ({count})::bigint as n_base, least({first})::bigint as first_word,
         greatest({last})::bigint as last_word, list_filter([{base}], lambda x: x is not null) as base,
         list_filter([{having}], lambda x: x is not null) as having_phrase
  from sized),
idx as (
  select doc_id, word, pos from (select doc_id, unnest(words) as word, unnest(range(len(words))) as pos from sized)
  where word in (select word from postings)),
df as (select word, count(distinct doc_id) as df from idx group by word),
seeds as (
  select doc_id, template, word from (select distinct doc_id, template, word from idx join postings using (word)) join df using (word)
  qualify row_number() over (partition by doc_id, template order by df, word) <= {L.SEEDS}),
banded as (
  select doc_id, template, word, k, unnest([2 * floor((pos - k) / {L.BAND}.0), 2 * floor((pos - k + {L.BAND // 2}) / {L.BAND}.0) + 1]) as band
  from idx join postings using (word)),
near as (select doc_id, template, band from banded join seeds using (doc_id, template, word)
         group by doc_id, template, band having count(distinct k) >= {L.AGREE}),
shares as (
  select doc_id, template, label, max(share) as share from (
    select doc_id, template, band, count(distinct k) / any_value(size) as share, any_value(label) as label
    from banded join near using (doc_id, template, band) join names using (template) group by doc_id, template, band)
  where share >= {L.SHARE} group by doc_id, template, label),
stand as (
  select doc_id, list(label) as labels, max(share) as best from shares join facts using (doc_id) where list_contains(having_phrase, template) group by doc_id)
select doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(list_distinct(base)), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') as labels,
       greatest(coalesce(best, 0.0), case when n_base > 0 then {L.BASE_SCORE} else 0.0 end)::double as score
from facts left join stand using (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_line_templates": OP2,
    "op3_url_rules": OP3,
    "op4_minhash_hamming": OP4,
    "op11_ball_tree": OP11,
    "op12_conversation_trie": OP12,
    "op13_license_index": _op13(),
}
