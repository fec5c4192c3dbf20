"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from ctxmix.llm.license_scan import BLOCK, CONTAINMENT, NAMES, PHRASES, TEMPLATES, VERSIONS, needed

OP2 = """
with recursive usable as (
    select vec_id, embedding::double[] as v from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
    select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a),
degree as (select a, count(*) as n from pairs group by a),
least_id as (select a, min(b) as m from reach group by a)
select e.vec_id, coalesce(d.n, 0)::bigint as n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) as component_id,
       e.vec_id <= coalesce(l.m, e.vec_id) as kept
from embeddings e left join degree d on d.a = e.vec_id left join least_id l on l.a = e.vec_id
"""

# A form's length without the text: header and footer of its role.
OP8 = r"""
with marks as (select '</s>[INST] ok [/INST]' as m),
turns as (
    select conv_id, turn, role, coalesce(text, '') as text, text as given from conversations
    union all select -7, 0, 'user', m, m from marks
    union all select -7, 1, 'assistant', m, m from marks)
select conv_id, count(*) as n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn nulls first, role nulls first, given nulls first)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn nulls first, role nulls first, given nulls first)) as loss_sha256,
       sum(length(text) + len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?SYS>>|\[ROLE |\[/ROLE\]'))
           + case role when 'user' then 16 when 'assistant' then 10 when 'system' then 18
             else 18 + coalesce(length(regexp_replace(role, '[^a-zA-Z0-9]', '%00', 'g')) - 1, 0) end)::bigint as formatted_chars
from turns group by conv_id
"""


def _phrase(phrase: str, label: str) -> str:
    parts = phrase.split()
    test = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
    return f"select doc_id, i, '{label}' as label from place where {test}"


def op9() -> str:
    """Every block against every template, without filters; a block needs a template's names, and its version's number if it
    has the word "version"."""
    listed = lambda words: f"{words.split()}::varchar[]"
    templates = ", ".join(f"('{k}', {sorted(set(t.split()))}, {needed(len(set(t.split())), CONTAINMENT)}, {listed(NAMES.get(k, ''))}, {listed(VERSIONS.get(k, ''))})"
                          for k, t in TEMPLATES.items())
    return rf"""
with texts as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
place as (select doc_id, w, unnest(range(len(w))) as i from texts where len(w) > 0),
base as ({" union all ".join(_phrase(p, k) for p, k in PHRASES.items())}),
based as (select doc_id, count(*) as n, min(i) as lo, max(i) as hi, list(distinct label) as labels from base group by doc_id),
templates(label, words, need, names, version) as (values {templates}),
blocks as (select doc_id, w[b + 1 : b + {BLOCK}] as own from (select doc_id, w, unnest(range(0, len(w), {BLOCK // 2})) as b from texts)),
found as (
    select doc_id, label, len(list_intersect(own, words)) / len(words)::double as containment
    from blocks, templates where len(list_intersect(own, words)) >= need and len(list_intersect(own, names)) = len(names)
      and (not list_contains(own, 'version') or len(list_intersect(own, version)) = len(version))),
matched as (select doc_id, list(distinct label) as labels, max(containment) as best from found group by doc_id)
select t.doc_id, len(t.w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') as labels,
       case when b.n > 0 then 1.0::double else coalesce(m.best, 0.0)::double end as score
from texts t left join based b using (doc_id) left join matched m using (doc_id)
"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"""xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda c, b:
        list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def op11(buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> str:
    """Single words; every different one is hashed once."""
    def words(table: str) -> str:
        return rf"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from {table}"""
    return rf"""
with docs as (select doc_id, {words("documents")}), target as (select {words("benchmark")}),
own as (select doc_id, unnest(w) as x from docs), wanted as (select unnest(w) as x from target),
hashed as (select x, ({crc32("x")} % {buckets}) as bucket from (select x from own union select x from wanted)),
total as (select (select count(*) from own)::double as s, (select count(*) from wanted)::double as t),
s as (select bucket, count(*) as n from own join hashed using (x) group by bucket),
t as (select bucket, count(*) as n from wanted join hashed using (x) group by bucket),
gain as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (total.s + {buckets}) / ((s.n + 1)::double * (total.t + {buckets}))))::bigint as g
         from s left join t using (bucket), total),
means as (select doc_id, floor(sum(g)::double / count(*))::bigint as weight from own join hashed using (x) join gain using (bucket) group by doc_id),
scored as (
    select doc_id, len(w) as n, coalesce(m.weight, 0) as weight,
           coalesce(m.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from docs left join means m using (doc_id)),
placed as (select *, row_number() over (partition by n >= {min_words} order by score desc, doc_id nulls first) as place from scored)
select doc_id, n::bigint as n_features, weight, score,
       case when n >= {min_words} and place <= {percent} * (select count(*) from scored where n >= {min_words}) // 100 then place end as rank
from placed
"""


def op13() -> str:
    """The cheapest edits by dynamic programming over what was written last: nothing (0), a system (1), user (2) or assistant (3) turn."""
    role = "case when {0} = 'u' then 'user' else 'assistant' end"
    z = crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")
    due = "case when b.state = 2 then 'a' else 'u' end"
    return rf"""
with recursive damaged as (
    select conv_id, turn, case when z = 4 then 'user' else role end as role,
           case z when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when z = 3 then [0, 1] else [0] end) as again
    from (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {z} % 20 as z from conversations) where z <> 0),
seen as (
    select *, row_number() over (partition by conv_id, role, text order by turn nulls first, again) as nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ending,
           row_number() over (partition by conv_id order by turn nulls first, role, text, again) as pos from damaged),
rows_ as (
    select conv_id, turn, role, text, pos, left(role, 1) as i,
           case when ending = '' then 'blank' when nth > 1 then 'duplicate' when right(ending, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from seen),
facts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) as n,
           count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated
    from rows_ group by conv_id),
neighbours as (
    select a.conv_id, count(*) as illegal from rows_ a join rows_ b on a.conv_id is not distinct from b.conv_id and b.pos = a.pos + 1
    where a.i || b.i not in ('su', 'ua', 'au') group by a.conv_id),
inserted(before, state, letters, lines) as (values
    (0, 0, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
    (2, 2, '', []), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, '', []), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])),
best as (
    select conv_id, 0::bigint as pos, 0 as state, {{'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]}} as found from facts
    union all
    select conv_id, pos, state, min(found) as found from (
        select r.conv_id, r.pos, op.letter, case op.letter when 'D' then b.state when 'R' then case when b.state = 2 then 3 else 2 end
               else case r.i when 's' then 1 when 'u' then 2 else 3 end end as state,
               {{'cost': b.cost + case op.letter when 'D' then 4 when 'R' then 3 else 0 end + case when op.letter <> 'D' and r.fault = 'truncated' then 3 else 0 end,
                 'audit': b.audit || op.letter,
                 'lines': list_concat(b.lines, case op.letter when 'D' then []::varchar[] when 'K' then [r.role || ':' || r.text]
                                               else [{role.format(due)} || ':' || r.text] end)}} as found
        from (select conv_id, pos, m.state, found.cost + 3 * length(letters) as cost, found.audit || letters as audit, list_concat(found.lines, m.lines::varchar[]) as lines
              from best join inserted m on best.state = m.before) b
        join rows_ r on r.conv_id is not distinct from b.conv_id and r.pos = b.pos + 1
        cross join (values ('K'), ('R'), ('D')) op(letter)
        where op.letter = 'D' or (r.fault not in ('blank', 'duplicate') and (op.letter = 'R' or r.i = {due} or (r.i = 's' and b.state = 0)))) moved
    group by conv_id, pos, state),
finished as (
    select b.conv_id, min({{'cost': found.cost + 3 * length(m.letters), 'audit': found.audit || m.letters, 'lines': list_concat(found.lines, m.lines::varchar[])}}) as f
    from best b join facts t on b.conv_id is not distinct from t.conv_id and b.pos = t.n join inserted m on b.state = m.before
    where m.state in (0, 3) group by b.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(f.cost, 0)::bigint as cost,
       coalesce(f.audit, '') as audit, sha256(coalesce(array_to_string(f.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join facts t on c.conv_id is not distinct from t.conv_id left join neighbours g on c.conv_id is not distinct from g.conv_id
left join finished e on c.conv_id is not distinct from e.conv_id
"""
